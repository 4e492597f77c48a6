"""Operators of the llm subpackage against plain versions, on rows that are hard for them."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rowtide.llm import chat, html_text, jaccard_join, merkle, packing, quality_classifier, quality_rules, sentencepieces, sharding, token_counts
from rowtide.llm.components import components
from rowtide.llm.html_blocks import leaf_blocks
from rowtide.llm.words import WORD

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977} lore{i % 13}" for i in range(9000))
# Null and empty texts, blanks, odd characters, repeated rows, a very long text.
TEXTS = [
    None, "", "   ", "a", "a b", "Same text here, twice.", "Same text here, twice.", "é x\x00y \U0001f600 ▁ end\n\n\tz",
    "one two three one two three\nLine\nLine\n  \nLine", "x" * 5000, LONG, LONG + " more", "UPPER CASE WORDS!! " * 30, "\r\n \x0b\x0c",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with ids, a null id, and columns that clash with those that operators add."""
    rows = [(i if i != 4 else None, t, "src0", 1) for i, t in enumerate(TEXTS)]
    schema = "doc_id BIGINT, text STRING, source STRING, score INT"
    clash = {n: F.lit("taken") for n in ("ids", "n_tokens", "fingerprint", "sequence_id", "shard", "votes", "run", "position", "n_words", "set_key")}
    return spark.createDataFrame(rows, schema).withColumns(clash).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_pieces_decode_and_cover_their_bytes(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = sentencepieces.sentencepiece_encode(docs, PIECES, decode=True).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = r["text"] or ""
        assert r["ids"] == model.encode(text) + [model.eos_id()] and r["decoded"] == model.decode(r["ids"])
        assert b"".join(text.encode()[a:b] for a, b in zip(r["starts"], r["ends"])) == text.encode()
    assert sentencepieces.sentencepiece_encode(empty, PIECES).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_compiled_maps_normalise_like_the_library(rule):
    import sentencepiece

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    own = sentencepieces.Normalizer(dict(sentencepieces._fields(library.serialized_model_proto()))[3])
    for text in ["", "  Ｈｅｌｌｏ  ①②  ﬁ x ", "ガギグ　ｶﾞ", "é Å", "​ a\tb\n", "½ ㌖", "   ", *[t for t in TEXTS if t and len(t) < 200]]:
        got, source = own(text)
        assert got == library.normalize(text)
        assert len(source) == len(got.encode()) + 1 and (np.diff(source) >= 0).all()


def windows_covered(words):
    seen = Counter(zip(words, words[1:], words[2:]))
    return len({i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)})


def test_statistics_of_texts(docs, empty):
    rows = quality_rules.text_statistics(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = r["text"] or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_distinct"]) == (len(words), sum(map(len, words)), len(set(words)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == windows_covered(words)
    assert quality_rules.judged(quality_rules.text_statistics(empty)).count() == 0


def test_repeated_windows_of_random_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    for r in quality_rules.text_statistics(df).collect():
        assert r["n_repeat_words"] == windows_covered(r["text"].split())


def test_estimate_matches_plain_expectation_maximisation(spark):
    rng = random.Random(5)
    rules = quality_rules.RULES[:4]
    votes = [[rng.choice([0, 1, 1, 1, None]) for _ in rules] for _ in range(400)]
    got = quality_rules.rule_accuracies(spark.createDataFrame([(v,) for v in votes], "votes ARRAY<INT>"), rules).first()
    share, good, bad = quality_rules.SHARE_GOOD, [quality_rules.RIGHT_ON_GOOD] * 4, [quality_rules.RIGHT_ON_BAD] * 4
    w = quality_rules.WEIGHT
    for _ in range(30):
        odds = share / (1 - share) * np.ones(len(votes))
        for r in range(4):
            odds *= [{1: good[r] / (1 - bad[r]), 0: (1 - good[r]) / bad[r], None: 1}[v[r]] for v in votes]
        q = odds / (1 + odds)
        share = (q.sum() + quality_rules.SHARE_GOOD * w) / (len(votes) + w)
        for r in range(4):
            is1, is0 = (np.array([v[r] == x for v in votes]) for x in (1, 0))
            made_up = w + quality_rules.PRIOR * q[is1 | is0].sum()
            good[r] = (q[is1].sum() + quality_rules.RIGHT_ON_GOOD * made_up) / (q[is1 | is0].sum() + made_up)
            made_up = w + quality_rules.PRIOR * (1 - q)[is1 | is0].sum()
            bad[r] = ((1 - q)[is0].sum() + quality_rules.RIGHT_ON_BAD * made_up) / ((1 - q)[is1 | is0].sum() + made_up)
    assert np.allclose([got["share"], *got["good"], *got["bad"]], [share, *good, *bad])


@pytest.mark.parametrize("size", [400, 40_000])
def test_a_rule_that_errs_on_good_texts_is_trusted_less(spark, size):
    """Rule 0 errs on 5 per cent of good texts, the others seldom: its lone bad vote rejects nothing."""
    rng = random.Random(11)

    def vote(good, r):
        error = 0.05 if r == 0 else 0.003
        return (0 if rng.random() < error else 1) if good else (0 if rng.random() < 0.6 else 1)

    rows = [(i, i % 10 > 0, [vote(i % 10 > 0, r) for r in range(6)]) for i in range(size)]
    df = spark.createDataFrame(rows, "id INT, good BOOLEAN, votes ARRAY<INT>")
    model = quality_rules.rule_accuracies(df, quality_rules.RULES[:6]).first()
    assert abs(1 - model["good"][0] - 0.05) < (0.02 if size < 1000 else 0.006)
    scored = quality_rules.quality_posterior(df, quality_rules.RULES[:6]).collect()
    lone = [r["p_good"] for r in scored if r["votes"].count(0) == 1 and r["votes"][0] == 0]
    strict = [r["p_good"] for r in scored if r["votes"].count(0) == 1 and r["votes"][0] == 1]
    assert min(lone) > 0.9 > max(strict) - 0.1 and min(lone) > max(strict)
    assert sum((r["p_good"] >= 0.5) != r["good"] for r in scored) < 0.02 * size
    assert sum((0 not in r["votes"]) != r["good"] for r in scored) > 2 * sum((r["p_good"] >= 0.5) != r["good"] for r in scored)


def test_long_texts_and_single_bad_votes(spark):
    rng = random.Random(9)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(15_000)]
    phrases = [" ".join(rng.choice(vocabulary) for _ in range(3)) for _ in range(300)]

    def natural(n, new=4):
        return " ".join(w for _ in range(n // 7) for w in [rng.choice(phrases), *(rng.choice(vocabulary) for _ in range(new))])

    book = natural(100_000)
    prices = " ".join(("$" if i % 8 == 0 else "") + w for i, w in enumerate(natural(240).split()))
    junk = ["buy now " * 60, "#### $$$$ ||| &&& " * 30, "LOUD WORDS!!! HERE!!! " * 20, "same line again and again\n" * 30]
    texts = [book, prices, *junk * 4, *(natural(300) for _ in range(100))]
    known = quality_rules.text_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING"))
    got = {r["doc_id"]: r for r in quality_rules.judged(known).collect()}
    words = book.split()
    blocks = [words[i : i + 1000] for i in range(0, len(words), 1000)]
    assert got[0]["n_block_distinct"] == sum(len(set(b)) for b in blocks)
    repeated = set()
    for start in range(0, len(words), 1000):
        windows = [tuple(words[i : i + 3]) for i in range(start, min(start + 1000, len(words) - 2))]
        seen = Counter(windows)
        repeated.update(start + i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3))
    assert got[0]["n_block_repeats"] == len(repeated)
    assert got[0]["n_distinct"] < 0.2 * len(words) and got[0]["n_repeat_words"] > 0.35 * len(words)
    assert 0 not in got[0]["votes"] and got[0]["kept"]
    assert got[1]["votes"].count(0) == 1 and got[1]["kept"]
    assert not any(got[i]["kept"] for i in range(2, 18)) and all(got[i]["kept"] for i in range(18, len(texts)))


def placed_well(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_are_whole_and_packed(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    pieces = packing.token_pieces(docs, WORDS, end_id=1, capacity=512)
    rows = packing.pack(pieces, capacity=512, tiebreak=("doc_id", "piece")).collect()
    coded = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for t in TEXTS)
    texts = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == r["piece"] * 512 and len(r["ids"]) == 4 * r["length"]
        texts[r["doc_id"]].append(np.frombuffer(r["ids"], "<u4"))
    assert sorted(tuple(np.concatenate(p).tolist()) for p in texts.values()) == coded
    assert placed_well(rows, 512) <= -(-sum(map(len, coded)) // 512) + 1
    assert packing.pack(packing.token_pieces(empty, WORDS, 1), tiebreak=("doc_id",)).count() == 0


def test_packing_equals_best_fit_decreasing(spark):
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(700)] + [60] * 400 + [100] * 5
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)] + [(-1, None), (-2, 0)], "id INT, length INT").repartition(5)
    rows = packing.pack(df, capacity=100, tiebreak=("id",)).collect()
    assert sorted(r["id"] for r in rows if r["sequence_id"] is None) == [-2, -1]
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        gaps.remove(min(fit)) if fit else None
        gaps.append((min(fit) if fit else 100) - n)
    assert placed_well([r for r in rows if r["sequence_id"] is not None], 100) == len(gaps)
    with pytest.raises(ValueError):
        packing.pack(df, capacity=50)


@pytest.mark.parametrize("n", [0, 3, 1003])
def test_shards_are_exact_and_gapless(spark, n):
    df = spark.createDataFrame([(i // 2, "x" if i % 3 else None) for i in range(n)], "doc_id INT, text STRING").repartition(7)
    rows = sharding.shard_documents(df.withColumn("slot", F.lit("taken")), 40, ["doc_id", "text"], seed=4).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((i // 2, "x" if i % 3 else None) for i in range(n))
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by[k]) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1


def test_draws_follow_the_hypergeometric_law(spark):
    from math import comb

    draws = spark.range(20_000).select(F.expr(sharding.hypergeometric("30D", "12D", "10D", sharding._uniform("id", "7"))).alias("k"))
    found = {int(r["k"]): r["count"] for r in draws.groupBy("k").count().collect()}
    for k in range(11):
        wanted = 20_000 * comb(12, k) * comb(18, 10 - k) / comb(30, 10)
        assert abs(found.get(k, 0) - wanted) < 5 * wanted**0.5 + 3
    big = spark.range(500).select(F.expr(sharding.hypergeometric("1e9D", "4e8D", "1e6D", sharding._uniform("id", "9"))).alias("k"))
    mean, spread = big.agg(F.mean("k"), F.stddev("k")).first()
    assert abs(mean - 4e5) < 5 * 490 / 500**0.5 and 400 < spread < 580


def test_matrix_keeps_row_and_column_sums(spark):
    counts = [5, 0, 100, 7, 1, 33, 2]
    sizes = spark.createDataFrame(list(enumerate(counts)), "part BIGINT, count BIGINT")
    rows = {r["part"]: r["sends"] for r in sharding.communication_matrix(sizes, 9, seed=1).collect()}
    assert [sum(rows[i]) for i in range(7)] == counts
    columns = [sum(rows[i][j] for i in range(7)) for j in range(9)]
    assert sum(columns) == sum(counts) and max(columns) - min(columns) <= 1 and min(map(min, rows.values())) >= 0


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=x>Home</a><li><a>News</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>The &amp; title</h1><p>First <b>para
 graph<br>goes on, here.<p>Second one, also long enough.<div class="ad">Buy now</div></article>
<section class="comments"><p>Nice post.</p></section><footer>&copy; 2020</footer></body></html>"""


def test_main_text_of_pages(spark):
    chain = html_text.learn(spark.createDataFrame([(PAGE,), (None,)], "html STRING"))
    rows = [(1, PAGE), (2, None), (3, ""), (4, "just text"), (5, PAGE), (6, "<p>" * 3000 + "deep"), (7, "<!-- <p>open"), (8, "<script>x")]
    df = spark.createDataFrame([(*r, "taken") for r in rows], "page_id INT, html STRING, text STRING")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df, chain).collect()}
    assert got[1] == got[5] == "The & title\n\nFirst para graph goes on, here.\n\nSecond one, also long enough."
    assert got[2] == got[3] == got[8] == "" and len(got) == len(rows)
    assert html_text.extract_text(df.filter("false"), chain).count() == 0


def test_formulas_and_fallbacks_are_text():
    def texts(html):
        return [(b.text, b.tag) for b in leaf_blocks(html)]

    assert texts("<p>where <math><mi>x</mi><mo>&lt;</mo><mn>1</mn></math> is small</p>") == [("where x<1 is small", "p")]
    assert texts("<p>see <svg><g><text>A</text><path d='M0'/><text>B</text></svg> here</p><p>next</p>") == [("see A B here", "p"), ("next", "p")]
    assert texts("<p>a <svg><text>open<p>b</p>") == [("a open", "p"), ("b", "p")]
    assert texts("<p>a <object data=x>fall <b>back</b></object> b</p>") == [("a fall back b", "p")]
    assert texts("<p>a <canvas>drawn</canvas> <noscript>plain</noscript> b</p>") == [("a drawn plain b", "p")]
    assert texts("<div><iframe src=x>frame &amp; <b>text</b></iframe></div>") == [("frame & text", "div")]
    assert texts("<svg><foreignObject><p>one</p><p>two</p></foreignObject></svg>") == [("one", "p"), ("two", "p")]
    assert texts("<p>a<script>x</script><style>y</style><template><p>z</p></template></p>b<svg><style>c</style></svg>") == [("a", "p"), ("b", "")]


def test_names_behind_many_others_count(spark):
    classes = " ".join(f"px{i} mt{i} flex" for i in range(40))
    assert "comments" in leaf_blocks(f'<div class="{classes} comments"><p>Nice.</p></div>')[0].names
    page = PAGE.replace('class="comments"', f'class="{classes} comments"')
    assert page != PAGE
    chain = html_text.learn(spark.createDataFrame([(PAGE,), (None,)], "html STRING"))
    rows = spark.createDataFrame([(1, PAGE), (2, page)], "page_id INT, html STRING")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(rows, chain).collect()}
    assert got[1] == got[2]


def test_held_out_layouts_and_viterbi():
    training = html_text.Training(pages=300, epochs=4)
    words = [f"word{i}" for i in range(200)]
    chain = html_text.fit([(html_text.features(leaf_blocks(p)), y) for p, y in html_text.labelled_pages(words, training)], training)
    wrong = total = 0
    for page, labels in html_text.labelled_pages(words, html_text.Training(pages=100, seed=77)):
        scores = chain.scores(html_text.features(leaf_blocks(page)))
        found = chain.viterbi(scores)
        wrong += sum(a != b for a, b in zip(found, labels))
        total += len(labels)
        if len(scores) <= 8:
            def value(y):
                return chain.first[y[0]] + sum(s * k for s, k in zip(scores, y)) + sum(chain.pairs[a, b] for a, b in zip(y, y[1:]))

            every = [[k >> i & 1 for i in range(len(scores))] for k in range(2 ** len(scores))]
            assert abs(max(map(value, every)) - value(found)) < 1e-9
    assert wrong / total < 0.03


def test_chats_keep_maximal_conversations(spark):
    logs = {1: "ab", 2: "abc", 3: "abcd", 4: "abx", 5: "abcd", 6: "b", 7: "ba", None: "zz"}
    rows = [(c, i, "user" if i % 2 else None, None if t == "x" else t) for c, turns in logs.items() for i, t in enumerate(turns)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").withColumn("i", F.lit(0))
    rows = chat.format_chats(df).collect()
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in rows}
    assert sorted(str(r["conv_id"]) for r in rows) == ["3", "4", "7", "None", "None"]
    assert got[4] == (3, "<||>\na<|end|>\n<|user|>\nb<|end|>\n<||>\n<|end|>\n")
    assert chat.format_chats(df.filter("false")).count() == 0


def test_counts_equal_greedy_pieces(docs, empty):
    first, later = token_counts.space_marked_vocabulary(PIECES)

    def greedy(word):
        at = n = 0
        while at < len(word):
            end = next((e for e in range(min(len(word), at + 64), at, -1) if word[at:e] in (later if at else first)), None)
            if end is None:
                return 1
            at, n = end, n + 1
        return n

    rows = token_counts.token_counts(docs, PIECES).collect()
    for r in rows:
        words = WORD.findall(r["text"] or "")
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(map(greedy, words)))
    assert len(rows) == len(TEXTS) and token_counts.token_counts(empty, PIECES).count() == 0
    rng = random.Random(8)
    for _ in range(300):
        made = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(8)}
        automaton = token_counts.Automaton(made, made)
        first = later = made
        for _ in range(10):
            word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
            assert automaton.count(word) == greedy_with(made, word)


def greedy_with(pieces, word):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_fingerprints_and_next_texts(docs, empty, spark):
    rows = merkle.compare_with_next(docs).collect()
    assert len(rows) == len(TEXTS)
    order = sorted(((-1 if i == 4 else i), t or "") for i, t in enumerate(TEXTS))[::-1]
    following = {k: order[(j + 1) % len(order)][1] for j, (k, _) in enumerate(order)}
    for r in rows:
        text, other = r["text"] or "", following[-1 if r["doc_id"] is None else r["doc_id"]]
        assert "".join(merkle.LEAF.findall(text)) == text
        n = len(text) // 3
        assert r["edited"] == text[: len(text) - n] + other[:n] and r["fingerprint"] == merkle.fingerprint(text)
        assert (r["near_next"] == 1) == (text == other) and 0 <= r["near_edited"] <= 1
    assert merkle.compare_with_next(empty).count() == 0
    one = merkle.compare_with_next(spark.createDataFrame([(1, "abcdef")], "doc_id BIGINT, text STRING")).first()
    assert one["edited"] == "abcdab"
    assert {r["text"]: r["fingerprint"] for r in merkle.merkle_fingerprints(docs).collect()}[LONG] == merkle.fingerprint(LONG)


def test_edits_are_located():
    before = "".join(f"Sentence number {i} of the text stands here.\n" for i in range(60))
    after = before.replace("number 31 of", "number 31 or")
    found = merkle.edits(merkle.fingerprint(before), merkle.fingerprint(after))
    spot = before.index("number 31 of")
    assert len(found) == 1 and found[0][0] <= spot < found[0][1] and found[0][1] - found[0][0] < 100
    assert 0.95 < merkle.likeness(merkle.fingerprint(before), merkle.fingerprint(after)) < 1


def test_classifier_learns_and_takes_any_text(docs, empty, spark):
    settings = quality_classifier.Settings(documents=200, buckets=1 << 12, epochs=5)
    rng = random.Random(4)
    rows = [(" ".join(rng.choice(["good", "plain", "words"]) for _ in range(30)), 1) for _ in range(60)]
    rows += [(" ".join(rng.choice(["b@d$", "###", "!!!"]) for _ in range(30)), 0) for _ in range(60)] + [(None, 1), ("x", None), ("", 1)]
    model = quality_classifier.learn(spark.createDataFrame(rows, "text STRING, label INT"), settings)
    scored = quality_classifier.quality_scores(docs, model, settings)
    got = scored.collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1
    fresh = spark.createDataFrame([("good words plain words",), ("### b@d$ !!!",)], "text STRING")
    good, bad = [r["score"] for r in quality_classifier.quality_scores(fresh, model, settings).collect()]
    assert good > 0.8 and bad < 0.2
    assert quality_classifier.quality_scores(empty, model, settings).count() == 0
    assert quality_classifier.learn(spark.createDataFrame([], "text STRING, label INT"), settings)[1] == 0


def test_held_out_labels_are_not_learned_from(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id BIGINT, text STRING")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    rows = quality_classifier.quality_training_rows(docs, labels, quality_classifier.Settings()).collect()
    assert {r["text"] for r in rows} == {f"text {i}" for i in range(200) if zlib.crc32(str(i).encode()) % 5}


def plain_components(rows, percent=85, width=4):
    def shingles(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}

    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and 100 * len(x & y) >= percent * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(x), least[root(k)]) for k, (i, x) in enumerate(sets))


@pytest.mark.parametrize("chunk,frequent", [(128, 32), (2, 2)])
def test_jaccard_components_equal_all_pairs(spark, chunk, frequent):
    rng = random.Random(chunk)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 60))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for _ in range(140):  # near copies, chains of edits, copies in other case
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        base.append(w)
        texts.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    passage = " ".join(f"p{i}" for i in range(12))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(k)) for k in range(30)]
    texts += [None, "", " \n", "Ab", "aB", "é", texts[0], texts[0]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id BIGINT, text STRING, component_id INT").repartition(6)
    join = jaccard_join.Join(chunk=chunk, frequent=frequent)
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(df, join).collect())
    assert got == plain_components(rows)
    kept = jaccard_join.one_of_each(df, join).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, _, c in got})


def test_jaccard_without_ids_and_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (0, "x")], "doc_id BIGINT, text STRING")
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(df).collect())
    assert got == Counter({(None, 2, None): 1, (1, 2, 1): 2, (0, 1, 0): 1})
    assert sorted(str(r["doc_id"]) for r in jaccard_join.one_of_each(df).collect()) == ["0", "1"]
    assert jaccard_join.jaccard_components(df.filter("false")).count() == 0


def test_one_of_each_by_set_and_without_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    c, d = " ".join(f"c{i}" for i in range(60)), " ".join(f"d{i}" for i in range(60))
    rows = [(5, a, 1), (5, b, 1), (3, b + " more", 1), (5, b.upper(), 0), (5, "", 1), (5, " ", 2), (5, a, 0), (7, a + " more", 1), (8, "", 3)]
    rows += [(None, c, 2), (None, c, 1), (None, c + " more", 1), (None, d, 4), (None, "", 1), (None, "", 1)]
    # Near copies of rows that have an id: those stay.
    rows += [(None, a + " and", 9), (None, b, 0)]
    kept = []
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, set_key INT").repartition(parts)
        kept.append(Counter(tuple(r) for r in jaccard_join.one_of_each(df).collect()))
    assert kept[0] == kept[1]
    got = Counter((i, x.strip()) for i, x, _ in kept[0].elements())
    near = [k for k in got if k[0] is None and k[1].startswith("c0")]
    assert len(near) == 1 and near[0][1] in (c, c + " more")
    del got[near[0]]
    assert got == Counter({(5, a): 1, (3, b + " more"): 1, (5, ""): 1, (8, ""): 1, (None, d): 1, (None, ""): 2})
    assert kept[0][(5, a, 0)] == 1 and kept[0][(5, "", 1)] == 1


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a INT, b INT")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}


def test_digests_of_the_first_query(spark):
    rows = sentencepieces.op1_sentencepiece(spark, "/root/testdata/sf0.001").limit(5).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)


def test_word_ids_of_odd_strings_match_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    library, memory, rng = Tokenizer.from_file(WORDS), packing.word_ids(WORDS), random.Random(7)
    letters = "aAbB.,'!?<|>sStTréÉßẞİıſŀĿŉ’́   \x1c\x85​中文٣½²ⅣǅẍÀàÿŸœ🙂 \t\n'll're've'd'm's0123456789_-"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += [t.replace("a", "<|endoftext|>").replace("b", "'Ll") for t in texts[:500]] + [t for t in TEXTS if t]
    counts, ids = memory.of(pa.array([None, *texts]).slice(1))
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
    assert counts.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_word_memory_forgets_and_stays_right():
    import pyarrow as pa
    from tokenizers import Tokenizer

    library, memory = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    memory.words.kept, memory.parts.kept = 50, 30
    for i in range(40):
        text = " ".join(f"w{j % 90}x{i * j % 70}, Common. é{j}" for j in range(i, i + 30))
        assert memory.of(pa.array([text]))[1].tolist() == library.encode(text, add_special_tokens=False).ids
