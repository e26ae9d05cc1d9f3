"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.llm import (
    html_text, image_copies, jaccard_join, language_id, lm_scoring, mixing, packing, quality, toxicity, warc,
)
from talus.llm.common import running_sum, scratch
from talus.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, size long, _x string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def line(k, n=60):
    return " ".join(WORDS[(k * 7 + i * (3 + k % 5)) % 20] + str((k + i * i) % 9) for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, line(k), "en" if k % 2 else "fr", f"s{k % 3}", 1, 0.0, True, 5, "y") for k in range(30)]
    rows += [(100, None, None, None, None, None, None, None, None), (101, "", "en", None, 0, 0.0, False, 1, ""), (102, " \n\t", None, "s1", 3, 0.0, True, 2, "")]
    rows += [(None, "no id here", "en", "s0", 1, 0.0, True, 1, ""), (5, line(5), "en", "s2", 1, 0.0, True, 5, "y"), (5, line(5), "en", "s2", 1, 0.0, True, 5, "y")]
    rows += [(103, "long " * 60_000, "en", "s0", 1, 0.0, True, 1, ""), (104, "x" * 200_000, "en", "s0", 1, 0.0, True, 1, "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, int(k % 5 != 0), int(k % 4 == 0)) for k in range(30)] + [(None, 1, 1), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def empty(df):
    return df.limit(0)


def test_running_sum_and_components(spark):
    rows = spark.range(50).select("id", F.lit(2).alias("v"))
    got = {r.id: r.s for r in running_sum(rows, ["id"], "v", "s").collect()}
    assert got == {k: 2 * k + 2 for k in range(50)}
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert {roots[k] for k in range(41)} == {0} and roots[101] == 100
    assert components(empty(edges)).count() == 0


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    total = sum(r.size for r in got)
    assert 0.5 * total < sum(r.taken for r in got) <= 1.5 * total
    assert mixing.mix(empty(docs)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.taken // r.size for r in got if r.size)


def test_quality(docs, labels):
    field = quality.train(docs, labels)
    got = quality.judge(docs, field, keep=["doc_id", "lang"]).collect()
    assert len(got) == docs.count() and not any(r.kept for r in got if r.n_words < 50)
    assert quality.train(docs, empty(labels)) is None
    assert quality.judge(empty(docs), None).count() == 0
    assert quality.kept_documents(docs, None).schema == docs.schema


def test_base_rules_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        words = [WORDS[k] for k in rng.integers(0, 4, rng.integers(0, 30))]
        text = "".join(w + rng.choice([" ", "\n", "\t", "#\n", " \n \n"]) for w in words)
        split = text.encode().split()
        windows = [tuple(split[i : i + 3]) for i in range(len(split) - 2)]
        marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        lines = [x for x in text.split("\n")]
        dup = sum(1 for i, x in enumerate(lines) if x.split() and x in lines[:i])
        n, chars, symbols, n_dup, repeat, failed = quality.base_rules(text)
        assert (n, n_dup, repeat) == (len(split), dup, len(marked))
        assert chars == sum(len(w) for w in split) and symbols == text.count("#")
        assert failed == (n < 50 or 100 * repeat > 50 * n)


def test_viterbi_by_brute_force():
    import itertools

    rng = np.random.default_rng(2)
    field = quality.Field()
    field.emit, field.move, field.first = rng.normal(size=field.emit.shape), rng.normal(size=(2, 2)), rng.normal(size=2)
    for n in range(1, 7):
        rows = quality.OFFSETS + rng.integers(0, quality.WIDTHS, (n, len(quality.WIDTHS)))
        score = lambda y: sum(field.emit[rows[i], y[i]].sum() for i in range(n)) + field.first[y[0]] + sum(field.move[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert tuple(field.viterbi(rows)) == best


def test_toxicity(docs, labels):
    scorer = toxicity.train(docs, labels)
    got = toxicity.score(docs, scorer).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.clean_documents(docs, scorer).schema == docs.schema
    blank = toxicity.train(docs, empty(labels))
    assert not blank.usable and toxicity.score(empty(docs), blank).count() == 0
    assert {r.score for r in toxicity.score(docs, blank).collect()} == {0.0}


def test_restoring(spark):
    plain = "the clown and the idiot met a moron stupid trash pathetic you are an " * 50
    decoder = toxicity.learn_characters(spark.createDataFrame([(plain,)], "text string"))
    for noisy, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("i.d.i.o.t", "idiot"), ("idiooot", "idiot"), ("iddiiot", "idiot"), ("cl0wn", "clown"), ("$tup1d", "stupid")):
        assert decoder.clean(noisy) == meant
    long = "stupididiotmoronclowntrash" * 3
    assert decoder.clean(".".join(long)) == long
    assert decoder.clean("2024") == "2024" and len(decoder.clean("x" * 100_000)) <= 100_000
    restored = lambda text: " ".join(decoder.runs(text.split(), lambda run: True))
    assert restored("pathetic an i d i o t met") == "idiot"
    assert restored("s t u p i d i d i o t").replace(" ", "") == "stupididiot" and "idiot" in restored("an id iot met")
    assert restored("y o u i d i o t m o r o n").replace(" ", "").endswith("idiotmoron")
    scorer = toxicity.Scorer(decoder, {"=idiot": 5.0, "^idio": 5.0, "=moron": 4.0})
    for text in ("you are a i d i o t", "s t u p i d i d i o t", "what an id iot he", "1 d 1 0 t", "i.d.i.o.t", "an iddiiot"):
        assert scorer.evidence(text)[0] == 1.0, text
    assert scorer.evidence("the clown met an old man in a hat")[0] == 0.0


def test_decoding_by_brute_force(spark):
    import itertools

    plain = "the clown and the idiot met a moron stupid trash pathetic you are an " * 50
    decoder = toxicity.learn_characters(spark.createDataFrame([(plain,)], "text string"))
    rng = np.random.default_rng(13)
    for _ in range(200):
        word = "".join(rng.choice(list("idot1.0@s  aa!")) for _ in range(rng.integers(1, 9))).strip() or "i"

        def cost(choice):
            x, y, total = 0, 0, 0.0
            for out, price, z in choice:
                total += price
                if out:
                    total, x, y = total - decoder.log[x][y][z], y, z
            return total - decoder.log[x][y][0]

        best = min(itertools.product(*toxicity.lattice(word)), key=cost)
        found = decoder.restore(word)
        same = [c for c in itertools.product(*toxicity.lattice(word)) if "".join(o for o, _, _ in c) == found]
        assert abs(min(map(cost, same)) - cost(best)) < 1e-9


def test_jaccard_join(spark, docs):
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.classes(docs).collect()}
    assert (5, 5, 2) in got and (100, 100, 0) in got and (101, 101, 0) in got and (None, None, 0) in got
    assert jaccard_join.classes(empty(docs)).count() == 0
    twins = docs.sparkSession.createDataFrame([(None, line(1)), (3, line(1)), (2, line(1))], "doc_id long, text string")
    assert {(r.doc_id, r.class_id, r.chosen) for r in jaccard_join.classes(twins).collect()} == {(None, 2, False), (3, 2, False), (2, 2, True)}
    kept = jaccard_join.deduplicated(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id BETWEEN 100 AND 102").count() == 3


def test_jaccard_join_by_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for g in range(12):
        base = [f"w{k}" for k in rng.integers(0, 500, 120)]
        for _ in range(rng.integers(1, 12)):
            words = list(base)
            for k in rng.integers(0, 120, rng.integers(0, 4)):
                words[k] = f"x{rng.integers(0, 9999)}"
            texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    links = [sum(len(a & b) * 10 >= 8 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in jaccard_join.classes(rows).collect()}
    assert [got[k] for k in range(len(texts))] == links


def test_large_nodes_split_and_block(spark, monkeypatch):
    shared = [f"s{k}" for k in range(60)]
    rows = [(k, " ".join(shared + [f"u{k}_{i}" for i in range(60)])) for k in range(60)] + [(100 + k, " ".join(shared * 2 + [f"v{k}"])) for k in range(40)]
    monkeypatch.setattr(jaccard_join, "SPLIT", 20)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == (k, 0) for k in range(60)) and all(got[100 + k] == (100, 39) for k in range(40))


def test_packing(spark, docs):
    got = packing.pack(docs, with_ids=True).collect()
    used = {}
    for r in got:
        assert 1 <= r.length <= 2048 and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    assert sum(r.doc_id == 100 and r.length == 1 for r in got) == 1
    assert packing.pack(empty(docs)).count() == 0


def test_ids_equal_the_tokenizers_own(spark):
    from tokenizers import Tokenizer

    texts = ["Hello, World. it's ÀÉ, naïve... don't!", "ΑΣ 12,5 áb é, <|endoftext|> x", " odd spaces\x00 ok", "Straße, İstanbul."]
    encode = Tokenizer.from_file(packing.public_tokenizer())
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.tokenized(rows, packing.public_tokenizer(), with_ids=True).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == encode.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]


def test_solver_is_near_the_bound():
    rng = np.random.default_rng(4)
    lengths = np.minimum(200, np.maximum(1, rng.lognormal(3.5, 0.9, 20_000).astype(int)))
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    plan = packing.solve(histogram, 200).plan
    assert sum(n for _, n in plan) <= -(-int(lengths.sum()) // 200) * 1.01 + 1
    packed = {}
    for items, often in plan:
        assert sum(k * n for k, n in items.items()) <= 200
        for k, n in items.items():
            packed[k] = packed.get(k, 0) + n * often
    assert packed == histogram
    assert packing.solve({}).plan == []


def test_lm_scoring(docs):
    held = docs.withColumn("held_out", F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)))
    got = lm_scoring.score(held, lm_scoring.train(held.where("NOT held_out"))).collect()
    assert len(got) == docs.count() and all(r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (100, 101, 102)} == {1}
    none = empty(held)
    assert lm_scoring.score(none, lm_scoring.train(none)).count() == 0
    assert all(r.n_known == 0 for r in lm_scoring.score(held.withColumn("held_out", F.lit(True)), lm_scoring.train(none)).collect())


def test_filter_keeps_levels():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 32, 6000, dtype=np.uint64))
    times = rng.integers(1, 40, 3000)
    seen = lm_scoring.probe(lm_scoring.build_filter(keys[:3000], times), keys).astype(int)
    exact = np.searchsorted(lm_scoring.EDGES, times, side="right") - 1
    assert (seen[:3000] >= exact).all() and (seen[:3000] == exact).mean() > 0.97
    assert (seen[3000:] == 0).mean() > 0.97
    assert (lm_scoring.probe(lm_scoring.build_filter(keys[:0], times[:0]), keys) == 0).all()


def lm_by_hand(rows):
    """(base score, score) of each text with exact counts: the model without a filter."""
    from collections import Counter

    words, grams = Counter(), {2: Counter(), 3: Counter()}
    for _, text, held in rows:
        t = ["", "", *text.lower().split(), ""]
        for i in range(2, len(t) if not held else 0):
            words[t[i]] += 1
            for k in grams:
                grams[k][tuple(t[i - k + 1 : i + 1])] += 1
    level = lambda c: np.searchsorted(lm_scoring.EDGES, c, side="right") - 1
    middle = lambda c: float(np.sqrt(float(lm_scoring.EDGES[level(c)]) * float(lm_scoring.LAST[level(c)])))
    table = lambda c: lm_scoring.histogram(np.array(list(c.values()), np.int64))
    mu = {2: lm_scoring.smoothing(table(words), sum(v == 1 for v in grams[2].values())), 3: lm_scoring.smoothing(table(grams[2]), sum(v == 1 for v in grams[3].values()))}
    n, out = sum(words.values()), {}
    for k, text, _ in rows:
        t, base, score = ["", "", *text.lower().split(), ""], 0.0, 0.0
        for i in range(2, len(t)):
            p = (words[t[i]] + 0.1) / (n + 0.1 * (len(words) + 1))
            base += np.log10(p)
            for size, history in ((2, words[t[i - 1]]), (3, middle(grams[2][tuple(t[i - 2 : i])]) if i > 2 else 0)):
                p = (min(middle(grams[size][tuple(t[i - size + 1 : i + 1])]), history) + mu[size] * p) / (history + mu[size])
            score += np.log10(p)
        out[k] = (base, score)
    return out


@pytest.mark.parametrize("shuffle, block", [(1, 1 << 20), (8, 600), (64, 3000), (211, 200)])
def test_lm_scores_by_brute_force(spark, monkeypatch, shuffle, block):
    """Scores are those of exact counts (within false positives), whatever the partitions, blocks and buckets."""
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block)
    rng = np.random.default_rng(7)
    rows = [(k, " ".join(f"w{x}" for x in rng.zipf(1.5, rng.integers(0, 40)) % 60), bool(k % 4 == 0)) for k in range(60)] + [(99, "unseen words only", True)]
    rows += [(100, rows[1][1], False)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
        model = lm_scoring.train(docs.where("NOT held_out"), room=40)
        got = {r.doc_id: r for r in lm_scoring.score(docs, model).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hand = lm_by_hand(rows)
    assert len(got) == len(rows) and (model.buckets > 1) == (block < 2000)
    for k, (base, score) in hand.items():
        assert abs(got[k].base_score - base) < 1e-6 * max(1, abs(base)) and abs(got[k].score - score) < 0.01 * max(1, abs(score))


@pytest.mark.parametrize("text, share", [("a " * 3000, 1.0), ("a b " * 900, 0.25), ("one two three four five " * 300, 0.25)])
def test_repeated_texts_score_above_their_words(spark, text, share):
    """A history with one continuation gives it nearly all, however often it comes: no step of the levels is lost at each token."""
    docs = spark.createDataFrame([(1, text, False), (2, text, False)], "doc_id long, text string, held_out boolean")
    for r in lm_scoring.score(docs, lm_scoring.train(docs)).collect():
        assert r.score > share * r.base_score - 10


def test_language_id(docs):
    model = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert got[100].lang_pred == got[101].lang_pred == got[102].lang_pred == "und"
    none = language_id.train(empty(docs))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    code = language_id.codewords(12)
    assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 10


def test_decoding_of_codes_by_brute_force(docs):
    import math

    model = language_id.train(docs.where("lang IS NOT NULL"))
    for text in ("alpha beta 7 gamma", "Omicron pi", "no id here", line(3)):
        raw = [32 if b in (9, 10, 11, 12, 13) else 48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in f" {text} ".encode()]
        cells = [(((a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) % 2**32) * 0x27D4EB2F % 2**32) >> 17 for a, b, c in zip(raw, raw[1:], raw[2:])]
        margins = [sum(float(model.weights[x, k]) for x in cells) / math.sqrt(len(cells)) for k in range(len(model.bits))]
        loss = [sum(w * math.log1p(math.exp(-int(c) * m)) for c, m, w in zip(word, margins, model.bits)) for word in model.code]
        best = min(range(len(loss)), key=loss.__getitem__)
        lang, score, _ = model.decode(text)
        assert lang == model.langs[best] and abs(score - 1 / sum(math.exp(loss[best] - x) for x in loss)) < 1e-6
    one = language_id.Model(["xx"], np.ones((1, language_id.BUCKETS)))
    assert one.decode("abc") == ("xx", 1.0, False) and one.decode("12")[0] == "und"


def test_html_against_a_plain_walk():
    """Random trees written as HTML: the words shown are those a plain walk of the tree shows, in its order."""
    rng = np.random.default_rng(17)

    def tree(depth):
        """(html, visible words) of one element."""
        tag = rng.choice(["div", "p", "span", "b", "ul", "table", "script", "hidden", "section", "h2"])
        words = [f"w{rng.integers(0, 999)}" for _ in range(rng.integers(1, 4))]
        if depth == 0 or tag in ("span", "b", "p", "h2"):
            tag = tag if tag in ("span", "b", "p", "h2") else "span"
            return f"<{tag}>{' '.join(words)}</{tag}> ", words
        parts = [tree(depth - 1) for _ in range(rng.integers(1, 4))]
        html, shown = "".join(h for h, _ in parts), [w for _, s in parts for w in s]
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{h}" for h, _ in parts) + "</ul>", shown
        if tag == "table":
            return "<table>" + "".join(f"<tr><td>{' '.join(s) or 'x'}" for _, s in parts) + "</table>", [w for _, s in parts for w in s or ["x"]]
        if tag == "script":
            return f"<script>{' '.join(words)}</script>" + html, shown
        if tag == "hidden":
            return f"<div style='display: none'>{html}</div>{words[0]} ", words[:1]
        return f"<{tag}>{html}</{tag}>", shown

    for _ in range(300):
        html, shown = tree(3)
        assert [w for w in html_text.visible_text(html).split() if w != "-"] == shown


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "same words " * 200
    rows = [(k, f"http://x/{k}", big) for k in (3, 9, 4)] + [(1, None, None), (2, "http://a\r\nb", "é\r\n\r\nWARC/1.1"), (None, "http://n", "<b>x"), (5, "u", "tiny"), (6, "u", "tiny")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, pages):
    whole, single = scratch(spark, "w"), scratch(spark, "m")
    warc.write_monolithic(pages, whole)
    index = warc.normalise(spark, whole, single)
    got = {r.page_id: r for r in warc.read_records(index, single).collect()}
    assert all(r.intact for r in got.values()) and len(got) == pages.count()
    assert (got[3].record_type, got[3].refers_to, got[9].record_type) == ("revisit", 9, "response")
    assert bytes(got[2].payload).decode() == "é\r\n\r\nWARC/1.1" and got[5].record_type == got[6].record_type == "response"
    proven = {r.page_id: r for r in warc.verified(warc.read_records(index, single)).collect()}
    assert all(r.intact for r in proven.values()) and proven[3].payload_bytes == proven[9].payload_bytes == len(bytes(got[9].payload))
    broken = warc.read_records(index, single).withColumn("payload_digest", F.when(F.col("page_id") == 3, "0").otherwise(F.col("payload_digest")))
    assert [r.page_id for r in warc.verified(broken.where("page_id <> 9 OR page_id IS NULL")).where("NOT intact").orderBy("page_id").collect()] == [3, 4]
    one = index.where("record_id IS NOT NULL").orderBy("archive", "offset").limit(1)
    assert warc.read_records(one, single).count() == 1
    nothing = scratch(spark, "w")
    warc.write_monolithic(empty(pages), nothing)
    assert warc.normalise(spark, nothing, scratch(spark, "m")).count() == 0


def test_broken_stream_keeps_whole_records():
    import gzip
    import io

    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = gzip.compress(record * 2000)
    count = lambda data: len(list(warc.records(warc.inflate(io.BytesIO(data).read))))
    assert count(data) == 2000 and 0 <= count(data[:-30]) <= 2000 and count(b"") == 0
    assert count(gzip.compress(record) + gzip.compress(record)) == 2
    big = b"WARC/1.1\r\nContent-Length: 40000000\r\n\r\n" + b"\0" * 40_000_000 + b"\r\n\r\n"
    assert count(gzip.compress(big) * 2) == 2


def test_html(pages):
    text = html_text.visible_text
    assert text("<ul><li>a<li>b<ul><li>c</ul></ul>") == "- a\n- b\n  - c"
    assert text("<table><tr><th>n<th>v<tr><td>aa<td>1</table>") == "n   v\naa  1"
    assert text("<p>a<p hidden>b<div style='display:none'>c</div><script>d</script>e") == "a\n\ne"
    assert text("x<br>y &amp; z") == "x\ny & z" and text(None) == text("") == ""
    assert text("<ol start=4><li>a<li>b</ol><pre> p\n  q</pre>") == "4. a\n5. b\n\n p\n  q"
    for hard in ('<a "' * 50_000, "<div>" * 50_000 + "x", "<table><tr><td>" * 500 + "x", "</p>" * 50_000):
        text(hard)
    got = html_text.extract(pages, keep=["page_id", "url"])
    assert got.columns == ["page_id", "url", "visible"] and got.count() == pages.count()


def test_images(spark):
    rng = np.random.default_rng(6)
    pictures = [image_copies.draw(rng.normal(size=64)) for _ in range(12)]
    rows = [(k, p) for k, p in enumerate(pictures)] + [(50, pictures[0]), (51, None), (52, b""), (53, b"P5 9 9 255\nxx")]
    images, members = image_copies.distinct_images(spark.createDataFrame(rows, "id long, data binary"))
    asked, askers = image_copies.distinct_images(spark.createDataFrame([(k, image_copies.edit(p, k)) for k, p in enumerate(pictures)], "id long, data binary"))
    found = image_copies.copies(images, asked).collect()
    name, ask = {r.id: r.image for r in members.collect()}, {r.id: r.image for r in askers.collect()}
    assert name[0] == name[50] and {(r.query, r.image) for r in found} == {(ask[k], name[k]) for k in range(12)}


def test_contract_columns_are_documented():
    from talus.llm import queries

    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert json.dumps(sorted(queries.SQL))
