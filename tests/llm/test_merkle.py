"""Trees of paragraphs: recomputed roots, edits, moves, likeness, and keys that many rows share."""

import hashlib
import random

import pytest

from rowtide.llm import merkle


def paragraph(rng, i):
    """Two or three leaves that no other paragraph has."""
    return " ".join(f"Sentence {i} {rng.randint(0, 10**9)}." for _ in range(rng.randint(2, 3))) + "\n"


def likeness_plainly(one, other):
    """By leaves alone, each as often as both have it; right where nothing moves or repeats."""
    leaves, others = merkle.LEAF.findall(one), merkle.LEAF.findall(other)
    shared = set(leaves) & set(others)
    return 2 * sum(map(len, shared)) / (len(one) + len(other))


def test_nodes_are_made_of_their_children():
    rng = random.Random(1)
    text = "".join(paragraph(rng, i) for i in range(70)) + "a last line without an end"
    tree = merkle.fingerprint(text)
    root, _, rest = tree.partition(":")
    at, digests = 0, []
    for section in rest.split("|"):
        inside = hashlib.blake2b(digest_size=16)
        for part in section[17:].split(";"):
            own = hashlib.blake2b(digest_size=16)
            begin = at
            for leaf in part[17:].split(","):
                piece = text[at : at + int(leaf[8:], 16)]
                digest = hashlib.blake2b(piece.encode(), digest_size=16).digest()
                assert digest.hex()[:8] == leaf[:8]
                own.update(digest)
                at += len(piece)
            assert text[begin:at].count("\n") <= 1 and own.hexdigest()[:16] == part[:16]
            inside.update(own.digest())
        assert inside.hexdigest()[:16] == section[:16]
        digests.append(inside.digest())
    assert at == len(text) and hashlib.sha256(b"".join(digests)).hexdigest() == root


def test_a_move_is_located_and_lowers_the_likeness():
    rng = random.Random(2)
    parts = [paragraph(rng, i) for i in range(50)]
    swapped = parts.copy()
    swapped[10], swapped[30] = swapped[30], swapped[10]
    one, other = (merkle.fingerprint("".join(p)) for p in (parts, swapped))
    starts = [sum(map(len, parts[:i])) for i in range(51)]
    assert one.split(":")[0] != other.split(":")[0] and 0.9 < merkle.likeness(one, other) < 1
    ranges = merkle.edits(one, other)
    assert ranges and all(any(starts[k] <= a and b <= starts[k + 1] for k in (10, 30)) for a, b in ranges)
    moved = merkle.moves(one, other)
    assert {k for a, b, _ in moved for k in (10, 30) if starts[k] <= a and b <= starts[k + 1]} == {10, 30}
    assert merkle.edits(one, one) == [] and merkle.likeness(one, one) == 1


def test_a_section_that_moves_whole():
    rng = random.Random(3)
    parts = [paragraph(rng, i) for i in range(60)]
    text, other = "".join(parts), "".join(parts[30:] + parts[:30])
    assert 0.6 < merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(other)) < 1
    moved = sum(b - a for a, b, _ in merkle.moves(merkle.fingerprint(text), merkle.fingerprint(other)))
    assert 0.4 * len(text) < moved < 0.6 * len(text)


@pytest.mark.parametrize("seed", range(5))
def test_likeness_of_edits_equals_that_of_leaves(seed):
    rng = random.Random(seed)
    parts = [paragraph(rng, i) for i in range(rng.randint(1, 60))]
    changed = [paragraph(rng, 1000 + i) if rng.random() < 0.2 else p for i, p in enumerate(parts) if rng.random() < 0.9]
    one, other = "".join(parts), "".join(changed)
    if one != other:
        assert abs(merkle.likeness(merkle.fingerprint(one), merkle.fingerprint(other)) - likeness_plainly(one, other)) < 1e-9


def test_chains_are_the_heaviest():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 7)
        ends = rng.sample(range(50), n)
        pairs = [(i, e, rng.randint(1, 9)) for i, e in enumerate(ends)]
        kept = merkle.in_place(pairs)
        best = 0
        for mask in range(1 << n):
            chosen = [pairs[i] for i in range(n) if mask >> i & 1]
            if all(a[1] < b[1] for a, b in zip(chosen, chosen[1:])):
                best = max(best, sum(c[2] for c in chosen))
        chain = [p for p, k in zip(pairs, kept) if k]
        assert all(a[1] < b[1] for a, b in zip(chain, chain[1:])) and sum(c[2] for c in chain) == best


def test_rows_of_one_key_and_without_are_spread(spark):
    rows = [(7 if i % 3 else None, f"text {i} " * (i % 5 + 1)) for i in range(600)] + [(i, "same") for i in range(20)] + [(7, "same")] * 3
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    ordered, run, guest = merkle.in_descending_runs(df, "doc_id", "text")
    found = ordered.collect()
    sizes = {}
    for r in found:
        sizes[r[run]] = sizes.get(r[run], 0) + 1
    assert len(sizes) == 8 and max(sizes.values()) < 3 * len(rows) / 8
    own = [(r["doc_id"], r["text"]) for r in found if not r[guest]]
    assert sorted(map(str, own)) == sorted(map(str, rows))
    # Each row's next text is that of the row behind it in one order of all rows.
    out = merkle.compare_with_next(df).collect()
    assert len(out) == len(rows)
    ids = [i for i, _ in rows if i is not None and i != 7]
    for r in out:
        if r["doc_id"] in ids and r["doc_id"] not in (0, 8):
            n = len(r["text"]) // 3
            assert r["edited"] == r["text"][: len(r["text"]) - n] + "same"[:n]
