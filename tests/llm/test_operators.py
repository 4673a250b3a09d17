"""Each operator on small cases against brute force, and on the edge cases of its docstring."""

import hashlib
import math
import os
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import byte_bpe, components, exact_dedup, gif, html_extract, katz, language_id, ngram_jaccard, packing, queries, toxicity, url_filter
from tessel.llm.common import remainder

LONG = "word " * 30_000
EDGE = [(1, None), (2, ""), (3, "same text here"), (4, "same text here"), (4, "same text here"), (None, "no id at all"), (5, LONG), (6, "   \n\t "), (7, "é ü ß 漢字 \U0001f600 a b c d e f")]


@pytest.fixture
def edge(spark):
    """Rows of every awkward kind, with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 0.5) for i, t in EDGE], "doc_id long, text string, lang string, piece int, kept string, score double")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --------------------------------------------------------------------------------------------------------------- packing


def test_chunks_give_the_ids_of_the_whole_text(docs):
    own = packing.ChunkEncoder(packing.tokenizer_path("byte_bpe_50k.json"))
    odd = ["", "a", "  a  b\n\n c \t d", "x \n y\n", "a\xa0b c", "\n", "1 2  3\n4", "it's we'll  don't", "é ü　x y", "<|endoftext|> a b", " a", "a ", "a\r\nb c", "a​ b", "a\x85d e", "a b., c.. d. 'e x's, q,' z", "ǆ ß. ²x x² ½. ١٢ x١.", "a\x00 b.\x00 c", "Mr. X, e.g. .5 ,6 _.", LONG]
    texts = odd + [r.text for r in docs.select("text").limit(80).collect()]
    assert own.encode(texts) == own.raw(texts)
    own.known.clear()
    assert [own.encode([t])[0] for t in odd] == own.raw(odd)


def test_packing(spark, edge, nothing):
    rows = packing.pack_documents(edge).collect()
    assert packing.pack_documents(nothing).count() == 0
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    tokenizer = packing.ChunkEncoder(packing.tokenizer_path("byte_bpe_50k.json"))
    for doc, text in [(1, ""), (5, LONG)]:
        ids = np.append(np.frombuffer(tokenizer.raw([text])[0], "<u4"), np.uint32(2)).astype("<u4")
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc)
        assert [o[1:] for o in own] == [(a, n, zlib.crc32(ids[a : a + n].tobytes())) for a, n in packing.cuts(len(ids))]
        assert all(n == packing.SEQUENCE for _, _, n, _ in own[1:])


def test_sum_of_squares_is_the_definition():
    rng = random.Random(1)
    lengths = np.array([rng.randint(1, 40) for _ in range(300)])
    bins, offsets, made = packing.sum_of_squares(lengths, 40)
    gaps: list[int] = []
    for k in np.argsort(-lengths, kind="stable"):
        size = int(lengths[k])
        fits = [g for g in set(gaps) if g >= size]
        count = Counter(g for g in gaps if g)

        def cost(gap, size=size, count=count):
            c = count.copy()
            c[gap] -= 1
            if gap > size:
                c[gap - size] += 1
            return sum(v * v for v in c.values())

        if fits:
            best = min(fits, key=lambda g: (cost(g), g))
            gaps.remove(best)
            gaps.append(best - size)
        else:
            gaps.append(40 - size)
    assert made == len(gaps)
    assert sorted(np.bincount(bins, lengths).astype(int)) == sorted(40 - g for g in gaps)


def test_many_tasks_take_hardly_more_sequences(spark):
    """Pieces of unfilled sequences of all tasks are packed together."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = []
    for tasks in (1, 64):
        rows = packing.pack_documents(docs.repartition(tasks, "doc_id"), block=300 if tasks == 1 else 60_000).select("sequence_id", "offset", "length").collect()
        by = defaultdict(list)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
        assert all(x + n == y for own in by.values() for (x, n), (y, _) in zip(sorted(own), sorted(own)[1:], strict=False)) and all(min(own)[0] == 0 for own in by.values())
        assert all(sum(n for _, n in own) <= packing.SEQUENCE for own in by.values())
        counts.append(len(by))
    least = math.ceil(sum(r.length for r in rows) / packing.SEQUENCE)
    assert counts[0] <= least + 8 and counts[1] <= least + 3  # tiny blocks of pieces, and many tasks


def test_sequences_hold_their_documents(spark, docs):
    pieces = packing.pack(packing.encode_pieces(docs.limit(20)).select("doc_id", "piece", "length", "ids"))
    got = packing.sequences(pieces).collect()
    assert sum(len(r.ids) // 4 for r in got) == pieces.agg(F.sum("length")).first()[0]


# ----------------------------------------------------------------------------------------------------------- exact dedup


def test_exact_dedup(spark, edge, nothing):
    rows = exact_dedup.content_sort(edge).collect()
    assert len(rows) == len(EDGE) and exact_dedup.content_sort(nothing).count() == 0
    groups = defaultdict(list)
    for i, t in EDGE:
        groups[t or ""].append(i)
    for r in rows:
        same = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.keep_id == max((x for x in same if x is not None), default=None) and r.group_size == len(same)
    assert sum(r.kept for r in rows) == len(groups)
    kept = exact_dedup.deduplicate(edge)
    assert kept.columns == edge.columns and kept.count() == len(groups)
    small = {r.doc_id: r.keep_id for r in exact_dedup.content_sort(edge, keep="smallest").collect()}
    assert small[2] == 1


def test_hot_text_is_split_and_whole(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("text"))
    got = exact_dedup.content_sort(df).where("text_sha256 = sha2('hot', 256)").agg(F.min("keep_id"), F.max("keep_id"), F.min("group_size"), F.sum(F.col("kept").cast("int")), F.count("*")).first()
    assert tuple(got) == (2997, 2997, 1000, 1, 1000)


# ----------------------------------------------------------------------------------------------------------------- media


@pytest.mark.parametrize("data", [b"", b"a", b"a" * 100_000, os.urandom(60_000), bytes(range(256)) * 300, LONG.encode()])
def test_gif_round_trip(data):
    payload = gif.padded(data)
    assert len(payload) % 192 == 0 and payload
    assert b"".join(f["region"][..., 0].tobytes() for f in gif.read_gif(gif.write_gif(payload))) == payload


def plain_lzw(stream, least):
    """LZW as the format describes it, bit by bit, with a table of strings."""
    bits = [b >> k & 1 for b in stream for k in range(8)]
    clear, end, at, out = 1 << least, (1 << least) + 1, 0, b""
    table, width, last = {}, least + 1, None
    while at + width <= len(bits):
        code = sum(bit << k for k, bit in enumerate(bits[at : at + width]))
        at += width
        if code == clear:
            table, width, last = {k: bytes([k]) for k in range(clear)} | {clear: b"", end: b""}, least + 1, None
            continue
        if code == end:
            return out
        entry = table[code] if code in table else last + last[:1]
        if last is not None and len(table) < 4096:
            table[len(table)] = last + entry[:1]
            if len(table) == 1 << width and width < 12:
                width += 1
        out, last = out + entry, entry
    return out


def test_lzw_against_a_plain_decoder():
    rng = random.Random(1)
    for data in (b"", b"a", bytes(7000), rng.randbytes(9000), b"abc " * 2500, bytes(range(256)) * 30, " ".join(rng.choices(("word", "and", "another"), k=4000)).encode()):
        stream = gif.lzw_encode(data)
        assert plain_lzw(stream, 8) == data == gif.lzw_decode(stream, 8, len(data))


def test_gif_rules():
    """Local palettes, transparency, disposal to background and previous, interlacing."""
    import struct

    def frame(box, samples, *, disposal=0, clear=None, interlaced=False, palette=None, delay=5):
        w, h = box[2:]
        flags = (0x40 if interlaced else 0) | (0x80 if palette else 0)
        return b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0\x2c" + struct.pack("<HHHHB", *box, flags) + (palette or b"") + b"\x08" + gif._blocks(gif.lzw_encode(bytes(samples)))

    red, blue = bytes([255, 0, 0, 0, 255, 0]), bytes([0, 0, 255, 9, 9, 9])
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 8, 0x80, 0, 0) + red
    data = head + frame((0, 0, 2, 8), [0] * 16) + frame((0, 0, 1, 1), [0], palette=blue, disposal=3) + frame((0, 1, 2, 1), [0, 1], clear=0, disposal=2) + frame((0, 0, 1, 8), [0, 1, 0, 1, 0, 1, 0, 1], interlaced=True) + b";"
    frames = [(f["time_ms"], f["canvas"].copy()) for f in gif.read_gif(data)]
    assert [t for t, _ in frames] == [0, 50, 100, 150]
    assert frames[1][1][0, 0].tolist() == [0, 0, 255, 255]
    assert frames[2][1][0, 0].tolist() == [255, 0, 0, 255]  # restored
    assert frames[2][1][1].tolist() == [[255, 0, 0, 255], [0, 255, 0, 255]]
    assert frames[3][1][1, 1].tolist() == [0, 0, 0, 0]  # disposed to the background
    order = gif._interlaced(8).tolist()
    assert [frames[3][1][y, 0].tolist()[1] for y in order] == [0, 255] * 4
    with pytest.raises(gif.Broken):
        list(gif.read_gif(data[:-20]))


def test_gif_operator(spark, edge, nothing):
    rows = gif.decoded_frames(gif.text_media(edge)).collect()
    assert len(rows) == len(EDGE) and all(r.error is None for r in rows)
    for r, (i, t) in zip(sorted(rows, key=lambda r: (r.doc_id or 0, r.n_bytes)), sorted(EDGE, key=lambda e: (e[0] or 0, len(e[1] or ""))), strict=True):
        assert (r.doc_id, r.n_bytes, bytes(r.payload)) == (i, len((t or "").encode()), gif.padded((t or "").encode()))
        want = Counter(b >> 4 for b in r.payload)
        assert [sum(f.own[k] for f in r.frames) for k in range(16)] == [want[k] for k in range(16)]
        assert sum(sum(f.own[:16]) for f in r.frames) == len(r.payload) and len(r.frames) == math.ceil(len(r.payload) / 192 / 128)
    assert gif.decoded_frames(gif.text_media(nothing)).count() == 0
    broken = spark.createDataFrame([(1, bytearray(b"GIF89a?")), (2, None)], "doc_id long, media binary")
    assert all(r.frames is None and r.error for r in gif.decoded_frames(broken).collect())


# ------------------------------------------------------------------------------------------------------------------- BPE


def test_bpe(spark, edge, nothing):
    own = byte_bpe.encoding(*byte_bpe.rank_file())
    for text in (LONG * 2, "a" * 70_000, ("x y\n " * 20_000), "é" * 40_000 + " b " * 9_000):
        assert [i for p in byte_bpe.segments(text, 1000) for i in own.encode_ordinary(p)] == own.encode_ordinary(text)
    rows = byte_bpe.encode(edge, decoded=True).collect()
    assert len(rows) == len(EDGE) and byte_bpe.encode(nothing).count() == 0
    want = sorted((i or 0, len(own.encode_ordinary(t or "")), (t or "").encode()) for i, t in EDGE)
    assert sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded)) for r in rows) == want
    assert sorted(bytes(r.decoded) for r in byte_bpe.decode(byte_bpe.encode(edge)).collect()) == sorted(w[2] for w in want)


# -------------------------------------------------------------------------------------------------------------- toxicity


def test_folding():
    assert toxicity.fold("1D10T") == "idiot" and toxicity.fold("ѕtuрid") == "stupid" and toxicity.fold("Scüm") == "scum"
    assert toxicity.fold("in 2024, 100 units") == "in 2024, 100 units"
    own = toxicity.base().automaton()
    assert toxicity.measure(toxicity.fold("what an 1diot"), own)[2] == 1
    assert toxicity.measure(toxicity.fold("a trash can by the idiotic door"), own)[2] == 0
    assert toxicity.measure(toxicity.fold("trash in a trash can"), own)[2] == 1


def test_hits_are_those_of_a_plain_search():
    rng = random.Random(5)
    words = ["ab", "abc", "b", "ca", "cab", "a b"]
    for _ in range(300):
        lexicon = toxicity.Lexicon({w: 1.0 + k for k, w in enumerate(rng.sample(words[:-1], 3))}, tuple(rng.sample(("ab c", "b a", "cab b"), 1)))
        text = "".join(rng.choices("abc  ", k=rng.randint(0, 30)))
        stands = lambda n, w: text.startswith(w, n) and not (n and text[n - 1].isalpha()) and not text[n + len(w) : n + len(w) + 1].isalpha()  # noqa: E731, B023
        spared = [(n, n + len(p)) for p in lexicon.exceptions for n in range(len(text)) if stands(n, p)]
        want = sorted((n, n + len(w), x) for w, x in lexicon.weights.items() for n in range(len(text)) if stands(n, w) and not any(a <= n and n + len(w) <= b for a, b in spared))
        assert sorted(toxicity.hits(text, lexicon.automaton())) == want


def test_other_labels_are_ignored(spark):
    rows = [(n, "you idiot there" if n % 2 else "a fine day") for n in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    odd = spark.createDataFrame([(0, 2), (1, -1), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels.union(odd)) == toxicity.learn(docs, labels)
    assert toxicity.learn(docs, odd) == toxicity.base()


def test_toxicity(spark, sf_dir, edge, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    lexicon = toxicity.learn(docs, labels, train=remainder("doc_id", 3) != 1)
    held = toxicity.score(docs, lexicon).join(labels, "doc_id").where(remainder("doc_id", 3) == 1).toPandas()
    clean, bad = held[held.toxic == 0], held[held.toxic == 1]
    assert (clean.score >= 0.7).mean() < 0.02 and (bad.score >= 0.7).mean() > 0.5
    rows = toxicity.score(edge, lexicon).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score < 0.5 for r in rows)
    assert toxicity.score(nothing, lexicon).count() == 0
    kept = toxicity.clean(edge, lexicon)
    assert kept.columns == edge.columns and kept.count() == len(EDGE)
    assert toxicity.learn(docs, labels.where("false")) == toxicity.base()


@pytest.mark.parametrize("word", ["жлоб", "मूर्ख", "바보", "غبي"])
def test_toxic_words_of_any_script(spark, word):
    rng = random.Random(2)
    text = lambda n, own: " ".join(f"{w} {own}" if own and k == 3 else w for k, w in enumerate(("".join(rng.choices("домрекघरनद집강나بيتنه", k=4)) for _ in range(8))))
    rows = [(n, text(n, word if n % 4 == 0 else "")) for n in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.learn(docs, docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) as toxic"))
    assert toxicity.fold(word) in lexicon.weights and toxicity.fold("idio\u0301t") == "idiot"
    assert all((r.score >= toxicity.LIMIT) == (r.doc_id % 4 == 0) for r in toxicity.score(docs, lexicon).collect())


# ------------------------------------------------------------------------------------------------------------------ URLs

URLS = [(1, "https://a.example.net/en/x"), (2, "http://EXAMPLE.net/fr/"), (3, "https://example.com/de/1?x=/en/"), (4, "https://w.org/fr/a#b"), (5, None), (6, "no scheme"), (7, "http://notexample.com/de/"), (8, "https://h.example.org"), (9, "https://x.net"), (10, "ftp://a.org?q=/fr/"), (2, "http://EXAMPLE.net/fr/")]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in URLS], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/fr/", "net/", "block")
    assert got[3] == ("example.com", "/de/1", "example.com/de/", "block")
    assert got[4][2:] == ("org/fr/", "allow") and got[7][2] is None
    assert got[5] == ("", "", None, "allow") == got[6]
    assert got[9][:3] == ("x.net", "", None) and got[10] == ("a.org", "", None, "allow")
    assert url_filter.filter_urls(pages).count() == len(URLS) and url_filter.filter_urls(pages.where("false")).count() == 0


def test_url_model(spark, sf_dir):
    got = url_filter.filter_urls(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).where("rule is null").toPandas()
    spam = got.host.str.contains("casino|pills|bets|spam|adult|ads-")
    assert (got[spam].verdict == "block").all() and (got[~spam].verdict == "allow").mean() > 0.98


def test_url_limit_is_of_all_readings(spark):
    rng = random.Random(9)
    names = ["".join(rng.choices(url_filter.SEEDS, k=2) if n % 10 == 0 else rng.choices("abcdeghiklmnopqrstuvwxyz", k=9)) for n in range(1500)]
    rows = [(n, f"http://{name}.zone.test/{n}") for n, name in enumerate(names)]
    urls = url_filter.ruled(url_filter.split_urls(spark.createDataFrame(rows, "page_id long, url string"), id_col="page_id", url_col="url"), url_filter.RULES)
    model = url_filter.fit(urls, contexts=400)
    assert len(model.accepted.table) <= 400
    texts = {url_filter.reading(r.host, r.path) for r in urls.select("host", "path").collect()}
    scores = [model.score(t) for t in texts if not url_filter.seeded(t, url_filter.SEEDS)]
    assert len(scores) > 1000 and sum(x > model.limit for x in scores) <= url_filter.FALSE * len(scores)


def test_url_model_of_more_contexts_than_are_held(spark, monkeypatch):
    """However few contexts may be held, all count: the same limit, ratios and verdicts as of a model over all readings."""
    rng = random.Random(6)
    letters = "abcdeghiklmnopqrstuvwxyzéß漢"
    names = ["".join(rng.choices(url_filter.SEEDS, k=2) if n % 10 == 0 else rng.choices(letters, k=9)) for n in range(200)]
    rows = [(n, f"http://{name}.zone.test/{n}/{name[:3]}?q") for n, name in enumerate(names)] + URLS
    rows += [(9000, "http://long.zone.test/" + "".join(rng.choices(letters, k=20_000))), (None, "http://casinopoker.zone.test/"), *rows[:9]]
    ruled = url_filter.ruled(url_filter.split_urls(spark.createDataFrame(rows, "page_id long, url string")))
    texts = {url_filter.reading(r.host, r.path) for r in ruled.where("host <> '' and coalesce(ruling, '') <> 'block'").collect()}
    plain = sorted(t for t in texts if not url_filter.seeded(t, url_filter.SEEDS))
    whole = url_filter.Ratio(url_filter.Markov(Counter(url_filter.follow(map(url_filter.signs, plain)))), url_filter.fit(ruled.where("false")).rejected)
    scores = sorted(map(whole.score, plain), reverse=True)
    whole.limit = max(0.0, scores[int(url_filter.FALSE * len(scores))])

    monkeypatch.setattr(url_filter, "PLACES", 2000, raising=False)
    model = url_filter.fit(ruled, contexts=100)
    assert len(model.accepted.table) <= 100 and model.limit == whole.limit
    assert all(model.score(t) == whole.score(t) for t in [*plain[:5], "^casino$", "^ÿþ$"])
    held = url_filter.fit(ruled, contexts=10**9)
    assert held.limit == whole.limit and held.accepted.table == whole.accepted.table
    others = spark.createDataFrame([(1, "http://casino-poker.zone.test/7"), (4000, "http://zz-slots9.zone.test/ÿ"), (2, "https://q.test"), *rows], "page_id long, url string")
    judged = [sorted(map(tuple, url_filter.judge(url_filter.ruled(url_filter.split_urls(others)), m).collect()), key=str) for m in (model, held, whole)]
    assert judged[0] == judged[1] == judged[2] and {v[4] for v in judged[0] if v[3] is None} == {"allow", "block"} and len(judged[0]) == len(rows) + 3


def test_markov_adds_up_over_all_bytes():
    texts = [url_filter.signs(t) for t in ("^abc$", "^abd$", "^größe$", "^漢字$")]
    m = url_filter.Markov(Counter(url_filter.follow(texts)))
    for context in ("", "a", "ab", "zz", texts[2][:4], texts[3][1:3]):
        assert sum(m.probability(context, chr(k)) for k in range(256)) == pytest.approx(1)


def test_markov_is_the_definition():
    """Witten-Bell by its recurrence, counted from the strings each time."""
    texts = ["^abab$", "^abc$", "^ca$"]
    m = url_filter.Markov(Counter(url_filter.follow(texts, 2)), order=2)

    def p(context, sign):
        after = [t[k] for t in texts for k in range(1, len(t)) if t[max(0, k - len(context)) : k] == context and k >= len(context)]
        lower = p(context[1:], sign) if context else 1 / 256
        return (after.count(sign) + len(set(after)) * lower) / (len(after) + len(set(after))) if after else lower

    for context in ("", "a", "b", "ab", "ba", "^a", "ca"):
        for sign in "abc$z":
            assert m.probability(context, sign) == pytest.approx(p(context, sign))


def test_ratio_judges_beyond_the_seed_words(spark):
    """Unseen names that are like the seeds fall, though no seed word stands in them; a clean one with a seed word passes."""
    rng = random.Random(4)
    rows = [(n, f"http://{''.join(rng.choices(('tion', 'the', 'an', 're', 'ing', 'her', 'on'), k=3))}.zone.test/page/{n}") for n in range(1500)]
    others = [(2000, "http://blog.thereanon-free.zone.test/page/9"), (3000, "http://casinos24.zone.test/1"), (3001, "http://pokerz-lotterys.zone.test/1"), (3002, "http://thetioning.zone.test/page/1")]
    ruled = lambda r: url_filter.ruled(url_filter.split_urls(spark.createDataFrame(r, "page_id long, url string")))
    got = {r.page_id: r.verdict for r in url_filter.judge(ruled(others + others[:1]), url_filter.fit(ruled(rows))).collect()}
    assert not any(url_filter.seeded(url_filter.reading(u.split("/")[2], "/1"), url_filter.SEEDS) for i, u in others if i in (3000, 3001))
    assert got == {2000: "allow", 3000: "block", 3001: "block", 3002: "allow"}


# ---------------------------------------------------------------------------------------------------------- n-gram join


def brute(rows, words=5):
    sets = defaultdict(set)
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        if w:
            sets[i, t] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)}
    least = {i: i for i, _ in rows if i is not None}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    keys = [k for k in sets if k[0] is not None]
    for n, x in enumerate(keys):
        for y in keys[:n]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(x[0]), find(y[0])
                least[max(a, b)] = min(a, b)
    return {i: find(i) for i in least}


def family(seed, n, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


def test_jaccard_join(spark, edge, nothing):
    texts = family(1, 60, 5) + family(2, 60, 2) + family(3, 5, 0) + ["a b c", "A  B\tc", "a b c d", "x", "X"]
    passage = " ".join(f"p{k}" for k in range(50))
    texts += [" ".join(f"u{n}_{k}" for k in range(200)) + " " + passage for n in range(80)]
    rows = [(1000 - k, t) for k, t in enumerate(texts)] + EDGE
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_jaccard.join(df)
    want = brute(rows)
    out = got.collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == want
    assert {r.doc_id: r.n_shingles for r in out}[1] == 0 and [r.component_id for r in out if r.doc_id is None] == [None]
    kept = ngram_jaccard.keep_one(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, None, 5, 6, 7}
    assert ngram_jaccard.join(nothing).count() == 0


@pytest.mark.parametrize("depth", [6, 0])
def test_hot_regions_are_split_and_whole(spark, monkeypatch, depth):
    """A family of near copies, many beyond the radius of one another, and a line that many hold, in regions far too large
    for a task: cut by distance, and by hash where ``DEPTH`` is used up."""
    monkeypatch.setattr(ngram_jaccard, "DEPTH", depth)
    monkeypatch.setattr(ngram_jaccard, "OFTEN", 8)
    line = " ".join(f"c{k}" for k in range(30))
    texts = family(5, 260, 14) + family(6, 120, 9) + [line + " " + " ".join(f"v{n}_{k}" for k in range(n % 14)) for n in range(160)]
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)] + [(2000 + k, t) for k, t in enumerate(texts[:80])]
    got = ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), leaf=(40, 1 << 20)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows)


def test_connect_is_brute_force():
    rng = np.random.default_rng(1)
    for seed in range(6):
        sets = [ngram_jaccard.shingles(t) for t in family(seed, 70, 10 + seed)] + [rng.choice(np.arange(40, dtype=np.uint64), rng.integers(1, 30), replace=False) for _ in range(30)]
        sets = [np.unique(x) for x in sets]
        visits = rng.random(len(sets)) < 0.5 if seed % 2 else None
        least = list(range(len(sets)))

        def find(x, least=least):
            while least[x] != x:
                x = least[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                if (visits is None or visits[i] != visits[j]) and ngram_jaccard.linked(sets[i], sets[j]):
                    a, b = find(i), find(j)
                    least[max(a, b)] = min(a, b)
        want = [find(i) for i in range(len(sets))]
        pairs = ngram_jaccard.connect(sets, (3, 4), None, visits)
        assert len(pairs) == len(sets) - len(set(want))
        own = list(range(len(sets)))
        for i, j in pairs:
            assert ngram_jaccard.linked(sets[i], sets[j])
            a, b = own[i], own[j]
            own = [min(a, b) if x in (a, b) else x for x in own]
        assert [min(k for k in range(len(sets)) if own[k] == x) for x in own] == want


def test_window_and_overlap():
    for n in range(1, 60):
        for m in range(1, 60):
            need = ngram_jaccard.least_overlap(n, m)
            assert need == min(k for k in range(n + m + 1) if 4 * k >= 3 * (n + m - k))
        assert ngram_jaccard.window(n) == n - math.ceil(0.75 * n) + 1


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    least = {x: x for p in pairs for x in p}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        least[max(x, y)] = min(x, y)
    got = {r.id: r.least for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


# ---------------------------------------------------------------------------------------------------------------- Katz


def katz_by_hand(rows, train, order):
    """Log10 probability, number of tokens, known tokens and base score of each row, by the definition; and the probability."""
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), "end"]
    learned = [tokens(t) for _, t in train]
    counts = [defaultdict(Counter) for _ in range(order)]
    for t in learned:
        for k in range(order):
            line = ["start", *t]
            for at in range(max(1, k), len(line)):
                counts[k][tuple(line[at - k : at])][line[at]] += 1
    words = counts[0][()]
    n, v = words.total(), len(words)
    factors = [katz.good_turing(Counter(c for own in level.values() for c in own.values())).factors for level in counts]
    q = [{x: {w: (factors[k][c] if c < len(factors[k]) else 1.0) * c / own.total() for w, c in own.items()} for x, own in counts[k].items()} for k in range(order)]
    for k in range(1, order):
        for x, own in q[k].items():
            if sum(own.values()) > 1 - 1e-9:
                q[k][x] = {w: p * counts[k][x].total() / (counts[k][x].total() + 1) for w, p in own.items()}
    unknown = 1 - sum(q[0].get((), {}).values())
    a = {}

    def p(x, w):
        if not x:
            return q[0].get((), {}).get(w, unknown)
        own = q[len(x)].get(x)
        if own is None:
            return p(x[1:], w)
        if w in own:
            return own[w]
        if x not in a:
            a[x] = (1 - sum(own.values())) / (1 - sum(p(x[1:], y) for y in own))
        return a[x] * p(x[1:], w)

    out = []
    for i, t in rows:
        line = ["start", *tokens(t)]
        score = sum(math.log10(p(tuple(line[max(0, at - order + 1) : at]), line[at])) for at in range(1, len(line)))
        out.append((i, len(line) - 1, sum(w in words for w in line[1:]), sum(math.log10((words[w] + 1) / (n + v + 1)) for w in line[1:]), score))
    return out, p, counts, n


@pytest.mark.parametrize("order, split", [(3, 1 << 40), (3, 20), (2, 1 << 40)])
def test_katz(spark, edge, nothing, monkeypatch, order, split):
    monkeypatch.setattr(katz, "SPLIT", split)
    monkeypatch.setattr(katz, "BLOCK", 700)
    rng = random.Random(5)
    vocabulary = [f"v{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for k in range(200)] + EDGE
    rows += [(300 + k, rows[k][1]) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = katz.score_documents(df, remainder("doc_id", 7) != 2, order=order).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    want, p, counts, n = katz_by_hand(rows, [r for r in rows if not held(r[0])], order)
    histories = [x for level in counts[1:] for x in list(level)[:15]] + [("start",)]
    words = counts[0][()]
    for x in histories:  # exactly normalised, the unknown word included
        assert sum(p(x, w) for w in words) + p(x, "never seen") == pytest.approx(1)
    key = lambda r: (-1 if r[0] is None else r[0], r[1], round(r[4], 6))
    have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key)
    for x, y in zip(have, sorted(want, key=key), strict=True):
        assert x[:3] == y[:3] and x[3:] == pytest.approx(y[3:], abs=1e-6)
    assert {r.doc_id: r.held_out for r in got} == {i: held(i) for i, _ in rows} and got[0].train_tokens == n
    if order == 3 and split > 1000:
        assert katz.score_documents(nothing, F.lit(True)).count() == 0
        blind = katz.score_documents(df, F.lit(False)).collect()
        assert len(blind) == len(rows) and all(r.n_known == 0 and r.score == 0.0 for r in blind)
        assert katz.score_documents(edge, F.lit(True)).count() == len(EDGE)


def test_katz_query_keeps_all_trigrams(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, " ".join(f"v{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 60)))) for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.op8_lm_scoring(spark, f"file://{tmp_path}").collect()}
    want, _, counts, _ = katz_by_hand(rows, [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2], 3)
    times = [c for own in counts[2].values() for c in own.values()]
    assert sum(c == 1 for c in times) > len(times) / 2
    assert all(got[i] == pytest.approx(score, abs=1e-5) for i, _, _, _, score in want)


# ------------------------------------------------------------------------------------------------------------------ HTML

PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a><li>News</ul></nav><div class='ad'>buy {n}</div><div class='wrap'><h1>Head {n}</h1><p>First &amp; foremost {n}<br>more<p><b>Second {n}</b> block<div class='share-box'>Share this</div><p>Sign up for our paper</p><section id='comments'><p>I agree {n}</p></section></div><footer>&copy; us {n}</footer></body></html>"


def test_html(spark):
    rows = [(k, f"https://h.example.org/{k}", PAGE.format(n=f"n{k}")) for k in range(8)] + [(100, "https://one.org/", "<article><h1>A</h1><p>b  c\n d</p><table><tr><td>x<td>y</table></article>"), (101, None, None), (102, "", ""), (103, "x", "plain text &lt;b&gt;"), (104, "http://z.org", "<div><p>unclosed <b>x <script>never ends"), (0, "https://h.example.org/0", PAGE.format(n="n0"))]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    for k in range(8):
        assert got[k] == f"Head n{k}\n\nFirst & foremost n{k} more\n\nSecond n{k} block"
    assert got[100] == "A\n\nb c d\n\nx y" and got[101] == "" == got[102]
    assert got[103] == "plain text <b>" and got[104] == "unclosed x"
    assert html_extract.extract(df).count() == len(rows) and html_extract.extract(df.where("false")).count() == 0


@pytest.mark.parametrize("bound", [html_extract.BROADCAST_BYTES, 0])
def test_large_wrappers_are_kept(spark, monkeypatch, bound):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", bound)
    frame = "".join(f"<div class='c{k}'><p>Constant {k}</p></div>" for k in range(400))
    rows = [(n, f"https://{host}/{n}", f"<html><body>{frame}<div class='text'><p>Own {host} {n}</p></div></body></html>") for host, count in (("hot", 60), ("b", 8)) for n in range(count)]
    rows.append((None, None, "<p>alone</p>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert len(html_extract.written(html_extract.skeleton([r[2] for r in rows[:12]]))) > 8_000
    got = sorted((r.url or "", r.text) for r in html_extract.extract(df).collect())
    assert got == sorted([("", "alone"), *((u, f"Own {u.split('/')[2]} {n}") for n, u, _ in rows[:-1])])


@pytest.mark.parametrize("bound", [html_extract.BROADCAST_BYTES, 0])
def test_templates_are_of_all_pages(spark, monkeypatch, bound):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", bound)
    rows, want = [], {}
    for n in range(120):
        box = "<div class='box'><p>Read on at home</p></div>" if n % 5 < 3 else ""
        if n % 40 == 7:  # a layout of few pages, with the article beside the slot of the others
            own = [f"Story {n} {k}" for k in range(9)]
            body = f"<div class='text'><p>Teaser {n}</p></div><div class='story'>{''.join(f'<p>{t}</p>' for t in own)}</div>"
        else:
            own = [f"Own {n} {k}" for k in range(3)]
            body = f"<div class='text'>{box}{''.join(f'<p>{t}</p>' for t in own)}</div>"
        rows.append((n, f"https://h.org/{n}", f"<html><body>{body}</body></html>"))
        want[n] = "\n\n".join(own)
    same = "<html><body><div class='text'><p>Many copies</p></div></body></html>"
    rows += [(n, "https://h.org/same", same) for n in range(1000, 3000)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and got[2999] == "Many copies"
    assert {n: got[n] for n in want} == want


def test_alignment_decides_where_names_say_nothing(spark):
    """Neutral elements and classes: which block is the article only the pages together can tell."""
    rows, want = [], {}
    for n in range(9):
        own = [f"Line {n} of {k} and more" for k in range(4)]
        body = "<div class='a'><p>Home</p><p>Sections</p></div>" + f"<div class='b'><div class='c'><h2>Title {n}</h2>{''.join(f'<p>{t}</p>' for t in own)}<p>Read us every day</p></div></div>" + "<div class='d'><p>All rights are ours</p><p>Contact</p></div>"
        rows.append((n, f"https://plain.org/{n}", f"<html><body>{body}</body></html>"))
        want[n] = "\n\n".join([f"Title {n}", *own])
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    assert all(html_extract.main_text(source, None) != want[n] for n, _, source in rows)


def test_loose_names_stay_in_articles():
    page = "<body><div class='social'>follow</div><article><section class='legal analysis'><p>Law</p></section><div class='social-history'><p>Then</p></div><div class='post-comments'><p>me too</p></div></article></body>"
    assert html_extract.main_text(page, None) == "Law\n\nThen"
    assert html_extract.main_text("<body><div class='social'>follow</div><p>text</p></body>", None) == "text"


def test_skeletons_are_written_and_read():
    top = html_extract.skeleton([PAGE.format(n=k) for k in range(3)])
    assert html_extract.read(html_extract.written(top)) == top


def test_deep_and_long_pages(spark):
    deep = "<div>" * 20_000 + "{n} deep" + "</div>" * 20_000
    rows = [(n, f"https://deep.org/{n}", deep.format(n=n)) for n in range(6)]
    rows += [(10 + n, f"https://long.org/{n}", "<body>" + "".join(f"<p>{n} {k}</p>" for k in range(30_000)) + "</body>") for n in range(5)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()}
    assert {n: got[n] for n in range(6)} == {n: f"{n} deep" for n in range(6)}
    assert all(got[10 + n] == "\n\n".join(f"{n} {k}" for k in range(30_000)) for n in range(5))


def naive_matching(a, b):
    """Simple tree matching by its recurrence, without any memory."""
    if not a or not b:
        return 0
    best = max(naive_matching(a[:-1], b), naive_matching(a, b[:-1]))
    if a[-1].label == b[-1].label:
        best = max(best, naive_matching(a[:-1], b[:-1]) + 1 + naive_matching(a[-1].children, b[-1].children))
    return best


def test_matching_is_brute_force(monkeypatch):
    rng = random.Random(9)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if depth else ''}</{t}>" for t in rng.choices(("div", "span", "b"), k=rng.randint(0, 4)))

    for _ in range(60):
        a, b = (html_extract.fold(html_extract.parse(tree(2)).children) for _ in range(2))
        want = naive_matching(a, b)
        assert html_extract.matching(a, b, {})[0] == want
        with monkeypatch.context() as m:
            m.setattr(html_extract, "CELLS", 0)
            assert html_extract.matching(a, b, {})[0] == want


def test_tree_matching():
    def tree(s):
        return html_extract.fold(html_extract.parse(s).children)

    a, b = tree("<div><h1>x</h1><p>y</p><ul><li>z</li></ul></div>"), tree("<div><p>y</p><ul><li>q</li></ul></div>")
    assert html_extract.matching(a, b, {})[0] == 4
    assert html_extract.matching(a, a, {})[0] == 5
    deep = "<div>" * 300 + "x" + "</div>" * 300
    assert html_extract.main_text(deep, None) == "x"


def test_long_lists_are_matched_by_the_same_rule(monkeypatch):
    rng = random.Random(3)
    blocks = ["<h2>x</h2>", "<p>y</p>", "<p><b>y</b> z <i>w</i></p>", "<ul><li>z<a>q</a></li></ul>", "<div><h3>u</h3><p><a>v</a></p></div>", "<div><p>u</p></div>"]

    def page(n):
        return html_extract.fold(html_extract.parse("".join(rng.choice(blocks) for _ in range(n))).children)

    for sizes in ((400, 300), (300, 400), (900, 150), (150, 900)):
        a, b = map(page, sizes)
        assert len(a) * len(b) > html_extract.CELLS
        got = html_extract.matching(a, b, {})
        with monkeypatch.context() as m:
            m.setattr(html_extract, "CELLS", 10**9)
            assert got == html_extract.matching(a, b, {})
    last = html_extract.parse("<h2>x</h2><p>y</p>" * 200 + "<div class='end'>c</div>"), html_extract.parse("<h2>x</h2><p>y</p>" * 300 + "<div class='end'>c</div>")
    assert (400, 600) in html_extract.matching(*(html_extract.fold(x.children) for x in last), {})[1]


# ----------------------------------------------------------------------------------------------------------- language ID


def test_language_id(spark, edge, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(docs, train=remainder("doc_id", 4) != 2)
    held = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(remainder("doc_id", 4) == 2).toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.97
    rows = {(r.doc_id, r.lang_pred) for r in language_id.identify(edge, model).collect()}
    assert {(1, "und"), (2, "und"), (6, "und")} <= rows and not any(p == "und" for i, p in rows if i in (3, 5, 7))
    assert language_id.identify(nothing, model).count() == 0 and language_id.learn(nothing) is None
    assert all(r.lang_pred == "und" for r in language_id.identify(edge, None).collect())
    kept = language_id.accepted(edge, model)
    assert kept.columns == edge.columns and not {1, 2, 6} & {r.doc_id for r in kept.collect()}


def test_spans_and_viterbi():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, k = int(rng.integers(1, 40)), 3
        scores = -rng.exponential(2, (n, k)) * (rng.random((n, k)) < 0.7)
        if n > 20:
            scores[: n // 2, 0] -= 4
            scores[n // 2 :, 1] -= 4
        path = language_id.viterbi(scores, 6.0)
        value = scores[0].copy()
        for t in range(1, n):
            value = scores[t] + np.maximum(value, value.max() - 6.0)
        worth = scores[np.arange(n), path].sum() - 6.0 * (np.diff(path) != 0).sum()
        assert worth == pytest.approx(value.max())


def test_scripts():
    weights = np.zeros((1, 2))
    m = language_id.Model(["en", "ru"], {}, weights, {"Latin": np.array([True, False]), "Cyrillic": np.array([False, True])})
    (lang, _, _), (other, _, spans), (ascii_only, _, _) = language_id.judged(["привет мир", "hello there friends and all привет мой дорогой друг и все остальные", "hello there friends"], m)
    assert lang == "ru" and ascii_only == "en" and other in ("en", "ru")
    assert {s["lang"] for s in spans} == {"en", "ru"}
    late = language_id.Model(["aa", "zz"], {}, weights, {"Latin": np.array([False, True]), "Cyrillic": np.array([True, False])})
    assert [x[0] for x in language_id.judged(["hello there friends", "héllo thére"], late)] == ["zz", "zz"]


def test_word_scores_are_sums_over_grams():
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdeéж漢"), rng.integers(1, 9))) for _ in range(400)] + ["x", "\U0001f600x"]
    known = sorted({g for w in words[:120] for g in language_id.grams(w)})
    weights = np.vstack([-rng.exponential(1, (len(known), 3)), np.zeros((1, 3))])
    m = language_id.Model(["a", "b", "c"], {g: k for k, g in enumerate(known)}, weights, {})
    for collisions in (20, 4):  # and with a table in which nearly all features share places
        language_id.Codes.SLOTS, m.codes = collisions, None
        got = m.score(words)
        for w, row in zip(words, got, strict=True):
            want = sum((weights[m.features[g]] for g in language_id.grams(w) if g in m.features), np.zeros(3)) / 2
            assert row == pytest.approx(np.maximum(want - want.max(), -language_id.MOST))
    language_id.Codes.SLOTS = 20


def test_viterbi_is_the_best_of_all_paths():
    from itertools import product

    rng = np.random.default_rng(8)
    for _ in range(30):
        n, k = int(rng.integers(1, 7)), 3
        scores = -rng.exponential(3, (n, k))
        worth = lambda path: scores[np.arange(n), list(path)].sum() - 4.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
        assert worth(language_id.viterbi(scores, 4.0)) == pytest.approx(max(map(worth, product(range(k), repeat=n))))


def test_small_languages_are_learned(spark):
    rng = random.Random(3)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(25))
    rows = [(n, text("abcdefgh"), "big") for n in range(3000)] + [(5000 + n, text("γδεζηθικ"), "el") for n in range(12)] + [(6000 + n, text("ßstuvwxyz"), "small") for n in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, sample=300, features=900)
    assert model.languages == ["big", "el", "small"] and len(model.features) <= 900
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows if lang != "big")


# --------------------------------------------------------------------------------------------------------- whole queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for table in ("documents", "pages"):
        c.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, sf_dir).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    key = sorted(theirs.columns)
    assert sorted(ours.columns) == key
    assert sorted(map(str, ours[key].itertuples(index=False, name=None))) == sorted(map(str, theirs[key].itertuples(index=False, name=None)))


def test_jaccard_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r.component_id for r in queries.QUERIES["op7_ngram_jaccard_join"](spark, sf_dir).collect()}
    assert got == brute(rows)


COLUMNS = {
    "op1": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op2": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op3": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op4": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op7": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op8": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op9": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op10": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_the_columns_and_digests(spark, sf_dir, name):
    number = name.split("_")[0]
    out = queries.QUERIES[name](spark, sf_dir)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[number]} == COLUMNS[number]
    rows = out.collect()
    table, key = ("pages", "page_id") if number in ("op6", "op9") else ("documents", "doc_id")
    given = {r[key]: r for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").collect()}
    assert {r[key] for r in rows} == set(given) and (number == "op1" or len(rows) == len(given))
    divisor = {"op5": (3, 1), "op8": (7, 2), "op10": (4, 2)}.get(number)
    for r in rows:
        text = (given[r[key]]["text"] or "") if table == "documents" else ""
        if divisor:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor[0] == divisor[1])
        if number == "op2":
            assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
        if number == "op3":
            payload = gif.padded(text.encode())
            assert (r.payload_sha256, r.tail_crc32, r.payload_bytes) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(payload))
            assert r.media_sha256 == hashlib.sha256(gif.write_gif(payload)).hexdigest()
        if number == "op4":
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        if number == "op5":
            assert r.predicted == int(r.score >= 0.7)
        if number == "op9":
            assert r.n_chars == len(r.text)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Stages on an empty table, and on rows with null identifiers, null and empty texts, repeats and clashing columns."""
    import corpus_pipeline as C

    rows = [(i, t, "en", "s", len(t or ""), "k") for i, t in EDGE] + [(10 + n, " ".join(f"{w}{n % 3}" for w in ("some", "words", "of", "prose", "and", "others", "that", "follow", "them")) + f" {n // 3}", "en", "s", 9, "k") for n in range(9)] + [(None, None, None, None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    spark.createDataFrame([(10, 1, 0), (11, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        docs = docs.withColumns({"hi": F.lit(1), "cell": F.lit("c"), "id": F.lit(0), "sequence_id": F.lit("s"), "score": F.lit("x")})
        columns, before = docs.columns, docs.count()
        for name, stage in C.STAGES[:-1]:
            docs = stage(spark, docs, f"file://{tmp_path}")
            assert docs.columns == columns, name
            assert docs.count() <= before
        packed = C.STAGES[-1][1](spark, docs, f"file://{tmp_path}")
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_are_their_operators_by_brute_force(spark, sf_dir):
    """What the stages keep, each held against a plain version on the same input."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(C.STAGES)
    kept = stages["language_id"](spark, docs, sf_dir)
    model = language_id.learn(docs, train=remainder("doc_id", 4) != 2)
    rows = {r.doc_id: r.text for r in docs.collect()}
    judged = dict(zip(rows, language_id.judged(list(rows.values()), model), strict=True))
    assert {r.doc_id for r in kept.collect()} == {i for i, (lang, score, _) in judged.items() if lang != "und" and score >= language_id.LEAST}
    civil = stages["toxicity"](spark, kept, sf_dir)
    lexicon = toxicity.learn(kept, labels, train=remainder("doc_id", 3) != 1)
    own = lexicon.automaton()
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert {r.doc_id for r in civil.collect()} == {i for i, t in rows.items() if lexicon.probability(*toxicity.measure(toxicity.fold(t or ""), own)[:2]) < toxicity.LIMIT}
    rows, last = {r.doc_id: r.text for r in civil.collect()}, {}
    for i in sorted(rows):
        last[rows[i]] = i
    single = stages["exact_dedup"](spark, civil, sf_dir)
    assert {r.doc_id for r in single.collect()} == set(last.values())
    apart = stages["ngram_jaccard_join"](spark, single, sf_dir)
    least = brute([(r.doc_id, r.text) for r in single.collect()])
    assert {r.doc_id for r in apart.collect()} == {i for i, c in least.items() if i == c}
    packed = stages["best_fit_packing"](spark, apart, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in apart.collect()}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
    assert 0 < docs.count() < before
    packed = C.run(spark, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
