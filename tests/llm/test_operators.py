"""Operators against brute force on small tables with nulls, empty and repeated texts, ties, and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdantia.llm import byte_bpe, decontaminate, html_text, jaccard_join, language_id, language_model, quality_rules, suffix_dedup, token_store, url_reputation

random.seed(1)
WORDS = ["loma", "tiré", "Öl", "a", "be", "x1", "don't", "日本", "re-do", "…"]
TEXTS = [None, "", "   ", "a", "one two"] + [" ".join(random.choices(WORDS, k=random.randint(3, 120))) for _ in range(40)]
TEXTS += [TEXTS[9], TEXTS[9] + " more", "=" * 700, "z" * 650, " ".join(WORDS * 40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "l", 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, hits string, n int")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_byte_bpe_round_trip(spark, docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    for most in (40, 1 << 18):
        got = by_id(byte_bpe.digests(byte_bpe.encode(docs, path, most=most), path))
        for k, t in enumerate(TEXTS):
            ids = library.encode_ordinary(t or "")
            assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_every_piece_is_folded_by_spark(spark, docs, monkeypatch):
    """Only pieces of more than LONG bytes leave the fold, which is exact for all bytes."""
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    draw = random.Random(2)
    pieces = [bytes(draw.choices(range(256), k=draw.randint(2, 40))) for _ in range(60)] + [b"=" * 500, b" internationalisation", b"aaaaaaaab"]
    df = spark.createDataFrame([(bytearray(p), 1) for p in pieces], "piece binary, n long")
    got = {bytes(r.piece): r.ids for r in df.select("piece", byte_bpe.fold_merges("piece", ranks).alias("ids")).collect()}
    assert got == {p: byte_bpe.merge_long(p, ranks) for p in pieces}
    called = []
    monkeypatch.setattr(byte_bpe, "merge_long", lambda piece, ranks: called.append(piece))
    assert byte_bpe.encode_pieces(df, ranks).count() == len(pieces) and not called


def test_ranks_stay_out_of_the_plan(spark):
    """Texts of a plan with the ranks in it had 12 MB, and the driver keeps several of each."""
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    pieces = [b"a", b" the", b" unfolded", b"\xff\xfe", b"zqzq" * 120]
    df = spark.createDataFrame([(bytearray(p), k) for k, p in enumerate(pieces)], "piece binary, n long")
    got = byte_bpe.encode_pieces(df, ranks)
    assert len(got._jdf.queryExecution().toString()) < 100_000
    assert {r.n: r.ids for r in got.collect()} == {k: byte_bpe.merge_long(p, ranks) for k, p in enumerate(pieces)}


def test_rank_tables_hold_each_pair_and_no_other():
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tables, token = byte_bpe.rank_tables(ranks), {v: k for k, v in ranks.items()}
    found = lambda a, b: tables["held"][tables["shift"][a] + b] ^ (a * (2**32 + 1))
    pairs = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
    left, right = np.array(list(pairs), np.int64).T
    assert (found(left, right) == (np.array(list(pairs.values())) << 16) + left).all()
    a, b = np.random.default_rng(3).integers(0, len(ranks), (2, 200_000))
    assert all((x < 2**32) == (token[i] + token[j] in ranks) and x & 65535 == i for x, i, j in zip(found(a, b).tolist(), a.tolist(), b.tolist()))


@pytest.mark.parametrize("scale", [0.3, 40])
def test_log_probs_against_the_plain_softmax(scale, monkeypatch):
    """One exponential a context class, place and class, and not a token; sums that are too small for that are still right."""
    rng, n, k = np.random.default_rng(4), 30, language_model.ORDER
    model = language_model.Model.start(np.full(n, 1 / n))
    model.context, model.target = (rng.normal(0, scale**0.5, x.shape).astype(np.float32) for x in (model.context, model.target))
    classes, context = rng.integers(0, n, 3000), rng.integers(0, n + 1, (3000, k))
    q = sum((model.context.astype(float) @ model.place[j])[context[:, j]] for j in range(k))
    s = q @ model.target.T.astype(float) + model.bias
    want = s[np.arange(3000), classes] - s.max(axis=1) - np.log(np.exp(s - s.max(axis=1)[:, None]).sum(axis=1))
    counted, plain = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, *a, **b: (counted.append(np.size(x)), plain(x, *a, **b))[1])
    assert np.allclose(model.log_probs(classes, context), want, rtol=1e-5, atol=1e-4)
    assert scale > 1 or sum(counted) <= k * (n + 1) * n


def test_token_store(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    out = f"file://{tmp_path}/tokens"
    lengths = token_store.write_tokens(docs, path, out, docs_a_bucket=7)
    got, at = by_id(token_store.read_tokens(spark, out, lengths)), 0
    for k, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[k].start, got[k].n_tokens) == (at, len(ids))
        assert got[k].ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        at += len(ids)


def test_decontamination_in_blocks(spark, docs):
    bench = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (10, TEXTS[9]), (1, "one two")], "item_id long, text string")
    whole = by_id(decontaminate.contamination(docs, bench, out="hits"))
    parts = by_id(decontaminate.contamination(docs, bench, out="hits", block_bytes=40))
    assert whole == parts
    assert whole[4].hits["items"] == ["1"] and whole[9].hits["items"] and not whole[1].hits["items"]


@pytest.mark.parametrize("part", [2, 4096])
def test_jaccard_against_brute_force(spark, docs, part, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIST", part)  # lists are dealt in parts
    got = by_id(jaccard_join.near_duplicates(docs, width=4, num=85, den=100))
    sets = [None if not (t or "").encode().lower().split() else {tuple((t or "").encode().lower().split()[k : k + 4]) for k in range(max(1, len((t or "").encode().lower().split()) - 3))} for t in TEXTS]
    part = list(range(len(TEXTS)))
    for a in range(len(TEXTS)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = [new if p == old else p for p in part]
    assert [got[k].component_id for k in range(len(TEXTS))] == part
    assert [got[k].n_shingles for k in range(len(TEXTS))] == [len(s or ()) for s in sets]


def test_bitmaps_judge_pairs_within_the_lists(spark, monkeypatch):
    """Texts with half of their words in common meet in many lists; next to none of their pairs may become rows, and no link may be lost."""
    draw = random.Random(4)
    own = lambda k: " ".join(f"w{draw.randrange(10**9)}" for _ in range(k))
    passage, wide = own(50), own(2000)  # bitmaps of one size, and of several that are folded
    texts = [f"{passage} {own(50)}" for _ in range(60)] + [f"{wide} {own(1900 + 10 * k)}" for k in range(20)]
    texts += [f"{texts[7]} {own(2)}", f"{texts[70]} {own(30)}"]
    made, near = [], jaccard_join._near

    def counted(pairs, marks, num, den):
        made.append(pairs.count())
        return near(pairs, marks, num, den)

    monkeypatch.setattr(jaccard_join, "_near", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(jaccard_join.near_duplicates(docs, width=5, num=80, den=100))
    assert [got[k].component_id for k in range(len(texts))] == [*range(80), 7, 70]
    assert made[-1] < len(texts)


@pytest.mark.parametrize(("bits", "least"), [(1024, 1024), (2048, 1024), (8192, 2048), (1 << 16, 4096)])
def test_folded_bitmaps(spark, bits, least):
    """Bit k of the folded bitmap is the parity of the shingles with hash k modulo its bits."""
    shingles = np.unique(np.random.default_rng(bits).integers(0, 1 << 63, bits // 4).astype(np.uint64))
    whole = jaccard_join.parities(shingles, np.array([0, len(shingles)]))
    assert len(whole[0]) * 64 == bits
    folded = spark.createDataFrame([(whole[0].as_py(),)], "b array<bigint>").select(jaccard_join._folded(F.col("b")).alias("b")).first().b
    odd = np.bincount((shingles % np.uint64(least)).astype(np.int64), minlength=least) & 1
    assert folded == np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


@pytest.mark.parametrize("group", [1, 1000])
def test_repeats_against_brute_force(spark, docs, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 900)  # long texts are cut in pieces
    got, data = by_id(suffix_dedup.remove_repeats(docs, group=group)), [(t or "").encode() for t in TEXTS]
    seen: dict = {}
    for d in data:
        for k in range(len(d) - 199):
            seen[d[k : k + 200]] = seen.get(d[k : k + 200], 0) + 1
    for i, d in enumerate(data):
        gone = {j for k in range(len(d) - 199) if seen[d[k : k + 200]] > 1 for j in range(k, k + 200)}
        assert (got[i].repeats["n_removed"], bytes(got[i].repeats["kept"])) == (len(gone), bytes(b for j, b in enumerate(d) if j not in gone))


def test_quality_bits_and_ablations(spark, docs):
    judged = quality_rules.ledger(docs, out="hits")
    assert by_id(judged)[0].hits["n_words"] == 0 and by_id(judged)[0].hits["bits"] & 1
    assert {r["rule"] for r in quality_rules.ablations(judged, out="hits").collect()} == set(quality_rules.RULES)
    assert quality_rules.quality_filter(docs).columns == docs.columns


def test_language_model_against_brute_force(spark, docs):
    """Counts and base score in plain Python; the model's probabilities are normalised over all words."""
    scored = by_id(language_model.score(docs, ~language_model.held_out(F.col("doc_id"), 10)), "key")
    words = {k: [w for w in re.split("[\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None] for k, t in enumerate(TEXTS)}
    counts = Counter(w for k, ws in words.items() if zlib.crc32(str(k).encode()) % 10 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    for k, ws in words.items():
        row = scored[k]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert abs(row.base_score - sum(log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)) < 1e-6 and row.score < 0


def test_language_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    shares = np.full(12, 1 / 12)
    model = language_model.Model.start(shares)
    every = np.concatenate([np.exp(model.log_probs(np.full(5, k), np.arange(20).reshape(5, 4) % 12)) for k in range(12)]).reshape(12, 5)
    assert np.allclose(every.sum(axis=0), 1, atol=1e-4)
    context = rng.integers(0, 12, (20_000, 4))
    target = (context[:, 0] + 1) % 12  # the word before decides
    trainer = language_model.Trainer(model, shares, 1)
    for at in range(0, len(target), 256):
        trainer.step(target[at : at + 256], context[at : at + 256])
    assert np.mean(trainer.m.log_probs(target[:500], context[:500])) > np.log(1 / 12) + 0.7


def test_language_id_on_held_out_texts(spark):
    """Accuracy on texts that were not learned from; null, blank and letterless texts; ids and sources are never looked at."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.held_out(F.col("doc_id"))
    network = language_id.fit(table.filter(~out))
    judged = language_id.identify(table.filter(out), network, out="x").select("lang", "x.lang", "x.score").toDF("lang", "guess", "score").collect()
    assert np.mean([r.lang == r.guess for r in judged]) > 0.97 and all(0 <= r.score <= 1 for r in judged)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "12 =="), (5, "the and of that with")], "doc_id long, text string")
    got = by_id(language_id.identify(odd, network, out="x"))
    assert [got[k].x["lang"] for k in range(1, 5)] == ["und"] * 4 and got[5].x["lang"] == "en"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, a text of five megabytes, and columns with the outputs' names."""
    long = " ".join(f"{w}{k}" for k, w in enumerate(WORDS * 70_000))
    rows = [(None, "one two three four five six seven"), (None, "one two three four five six seven"), (3, TEXTS[9]), (3, TEXTS[9]), (4, None), (4, ""), (5, long), (6, long[:200_000])]
    return spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], "doc_id long, text string, quality int, repeats string, lang string").repartition(3)


def _run(spark, name, docs, tmp_path):
    path = public_tokenizers.path
    if name == "bpe":
        return byte_bpe.encode(docs, path("byte_bpe_multi_50k.tiktoken"))
    if name == "url":
        return url_reputation.judge(docs.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "url"), docs.select("doc_id", "quality", F.lit(0).alias("toxic")))
    if name == "lm":
        return language_model.score(docs, ~language_model.held_out(F.col("doc_id"), 10))
    if name == "no learning":
        return language_model.score(docs, F.lit(False))
    if name == "decontaminate":
        return decontaminate.contamination(docs, spark.createDataFrame([(None, "one two three"), (2, None), (3, TEXTS[9])], "item_id long, text string"), out="quality")
    if name == "no items":
        return decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string"), out="quality")
    if name == "jaccard":
        return jaccard_join.near_duplicates(docs)
    if name == "suffix":
        return suffix_dedup.remove_repeats(docs)
    if name == "html":
        return html_text.main_text(docs.withColumnRenamed("doc_id", "page_id").withColumn("url", F.col("repeats")).withColumnRenamed("text", "html"))
    if name == "quality":
        return quality_rules.ledger(docs)
    if name == "store":
        lengths = token_store.write_tokens(docs, path("word_bpe_49k.json"), f"file://{tmp_path}/t")
        return token_store.read_tokens(spark, f"file://{tmp_path}/t", lengths)
    return language_id.identify(docs, language_id.fit(docs), out="repeats")


OPERATORS = ["bpe", "url", "lm", "no learning", "decontaminate", "no items", "jaccard", "suffix", "html", "quality", "store", "language"]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, odd, name, tmp_path):
    assert _run(spark, name, odd.filter("false"), tmp_path).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_null_ids_repeated_rows_long_texts_and_clashing_names(spark, odd, name, tmp_path):
    rows = _run(spark, name, odd, tmp_path).collect()
    assert len(rows) == 8
    ids = Counter(r[0] if name != "store" else r["doc_id"] for r in rows)
    assert ids == {None: 2, 3: 2, 4: 2, 5: 1, 6: 1}
    if name == "suffix":
        got = {r.doc_id: r.repeats for r in rows if r.doc_id in (5, 6)}
        assert got[5]["n_removed"] >= 200_000 - 1000 and got[6]["n_removed"] == got[6]["n_bytes"]
    if name == "decontaminate":
        assert {(r.doc_id, len(r.quality["runs"]) > 0, tuple(r.quality["items"])) for r in rows} >= {(None, True, ()), (3, True, ("3",)), (4, False, ())}


def test_deduplicate_keeps_one_row_of_each_component(spark):
    t, near = TEXTS[9] + " a b c d e f g", TEXTS[9] + " a b c d e f g h"
    rows = [(1, t), (1, t), (2, near), (None, t), (3, "quite another text of its own here"), (3, "quite another text of its own here"), (2, "a third text with the id of a near copy"), (4, None), (5, "")]
    left = jaccard_join.deduplicate(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int"))
    assert left.columns == ["doc_id", "text", "row"]
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(1, t), rows[4], rows[6], (4, None), (5, "")])
    ids = [(None, "same words in both of these rows here"), (None, "same words in both of these rows here")]
    assert jaccard_join.deduplicate(spark.createDataFrame(ids, "doc_id long, text string")).count() == 1


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://WWW.Example.com/en/x?q"), (2, "https://a.example.com/en/"), (3, "nourl"), (4, None), (5, "http://a.net/es/1"), (6, "http://b.org/?/")], "page_id long, url string")
    labels = spark.createDataFrame([(6, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(url_reputation.judge(pages, labels), "page_id")
    assert [got[k].rule for k in range(1, 7)] == ["www.example.com/en/", "example.com/en/", None, None, "net/es/", None]
    assert (got[1].host, got[1].path, got[4].host, got[6].path) == ("www.example.com", "/en/x", "", "/")


def test_html(spark):
    boiler = "<p>this boiler plate is on every page</p>"
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<nav>menu</nav>{boiler}<p>own text {k} &amp; more<br>x") for k in range(5)] + [(9, None, None)], "page_id long, url string, html string")
    got = by_id(html_text.main_text(pages), "page_id")
    assert got[3].text == "own text 3 & more x" and got[9].text == ""


def hinted(k, shared):
    box = "<div class='related-box'><p>see our other pages on this topic</p></div>" if shared else ""
    return f"<body><nav><p>go home</p></nav><article><p>text {k} of the article</p><div class='search-results'><p>result {k} of the study</p></div>{box}<div class='search'><p>search here for more of it</p></div></article></body>"


@pytest.mark.parametrize("shard", [256, 2])
def test_the_host_decides_on_hints(spark, shard, monkeypatch):
    """A class word that articles use as well is a hint: shared blocks go, others stay. Without the host's array they would stay."""
    pages = spark.createDataFrame([(k, f"http://h/{k}", hinted(k, k < 3)) for k in range(7)], "page_id long, url string, html string")
    got = by_id(html_text.main_text(pages, pages_a_shard=shard), "page_id")
    assert [got[k].text for k in range(7)] == [f"text {k} of the article\n\nresult {k} of the study" for k in range(7)]


def brute_boilerplate(pages):
    """Every run of blocks of at least LEAST_WORDS words, on how many pages it stands, and which blocks it so covers."""
    seen = defaultdict(set)
    for k, blocks in enumerate(pages):
        for a in range(len(blocks)):
            for b in range(a + 1, len(blocks) + 1):
                if sum(n for _, n, _ in blocks[a:b]) >= html_text.LEAST_WORDS:
                    seen[tuple(h for h, _, _ in blocks[a:b])].add(k)
    out = []
    for blocks in pages:
        gone = set()
        for a in range(len(blocks)):
            for b in range(a + 1, len(blocks) + 1):
                n = len(seen.get(tuple(h for h, _, _ in blocks[a:b]), ()))
                gone |= {j for j in range(a, b) if n >= html_text.least_pages(blocks[j][2], len(pages))}
        out.append(gone)
    return out


def test_shared_runs_against_brute_force():
    draw = random.Random(4)
    for _ in range(150):
        kinds = draw.choice([(html_text.OUTSIDE, html_text.HINT_OUTSIDE), (html_text.INSIDE, html_text.HINT_INSIDE)])
        size = {h: draw.randint(1, 5) for h in range(9)}
        pages = [[(h := draw.randrange(9), size[h], draw.choice(kinds)) for _ in range(draw.randint(0, 6))] for _ in range(draw.randint(0, 12))]
        want = brute_boilerplate(pages)
        assert html_text.boilerplate(pages) == want
        counts = Counter(h for blocks in pages for h in {r for r, _, _ in html_text.least_runs(blocks)})
        if len(pages) > 1:
            assert [html_text.covered(blocks, counts, len(pages)) for blocks in pages] == want


class Here:
    """Stands for a frame of texts: runs the function of ``mapInArrow`` in this process."""

    def __init__(self, spark, texts):
        self.sparkSession, self.texts = spark, texts

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        list(run(iter([pa.RecordBatch.from_arrays([pa.array(self.texts, pa.string())], names=["text"])])))
        return self.sparkSession.range(0).selectExpr("cast(id as int) as i", "0d as v", "1L as n")


def test_language_model_learns_every_token_once(spark, docs, monkeypatch):
    held, shares, *_ = language_model.vocabulary(language_model.piece_counts(docs, language_model.words, "text"), len(TEXTS))
    targets = []
    monkeypatch.setattr(language_model, "_steps", lambda trainer, kept: targets.extend(k for kind, _ in kept for k in kind.tolist()) or 0)
    language_model.train(Here(spark, TEXTS), held, shares)
    _, kind, _ = held.tokens(language_model.words(pa.array(TEXTS, pa.string())))
    assert sorted(targets) == sorted(kind.tolist())


def vocabulary_of(spark, docs):
    return language_model.vocabulary(language_model.piece_counts(docs, language_model.words, "text"), len(TEXTS), 12)[:2]


def test_scoring_hashes_words_once(spark, docs, monkeypatch):
    held, shares = vocabulary_of(spark, docs)
    model, texts = language_model.Model.start(shares), pa.array(TEXTS * 3, pa.string())
    hashed, hashes = [], language_model.Cut.hashes
    monkeypatch.setattr(language_model.Cut, "hashes", lambda cut: hashed.append(1) or hashes(cut))
    language_model._scored(texts, held, model, len(TEXTS))
    assert len(hashed) == 1


def test_contexts_and_classes_of_tokens(spark, docs):
    """Against a plain loop, with only 12 words that are known."""
    held, _ = vocabulary_of(spark, docs)
    rows, kind, context = held.tokens(language_model.words(pa.array(TEXTS, pa.string())))
    at = word = 0
    assert -1 in rows
    for t in TEXTS:
        before = [held.size] * language_model.ORDER
        for w in [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split(), None]:
            if w is not None:
                mine = held.classes[rows[word]] if rows[word] >= 0 else held.group[w[0] * 256 + (w[1] if len(w) > 1 else 0)]
                word += 1
            assert kind[at] == (held.end if w is None else mine) and context[at].tolist() == before
            before, at = [kind[at], *before[:-1]], at + 1
    assert (at, word) == (len(kind), len(rows))


def test_a_training_step_against_plain_sums():
    rng, n, classes = np.random.default_rng(3), 40, 9
    trainer = language_model.Trainer(language_model.Model.start(np.full(classes, 1 / classes)), np.full(classes, 1 / classes), 5)
    m, kind, context = trainer.m, rng.integers(0, classes, n), rng.integers(0, classes + 1, (n, language_model.ORDER))
    old = [x.astype(np.float64) for x in (m.context, m.target, m.place, m.bias)]
    noise = np.minimum(np.searchsorted(trainer.cdf, np.random.default_rng(5).random(language_model.NOISE), "right"), classes - 1)
    g = [np.zeros_like(x) for x in old]
    for c, ctx in zip(kind, context, strict=True):
        q = sum(old[0][ctx[k]] @ old[2][k] for k in range(language_model.ORDER))
        dq = 0
        for j, is_real in [(c, 1), *((j, 0) for j in noise)]:
            d = (1 / (1 + np.exp(-(old[1][j] @ q + old[3][j] - trainer.log_noise[j]))) - is_real) * 8 / n
            dq = dq + d * old[1][j]
            g[1][j] += d * q
            g[3][j] += d
        for k in range(language_model.ORDER):
            g[0][ctx[k]] += old[2][k] @ dq
            g[2][k] += np.outer(old[0][ctx[k]], dq)
    trainer.step(kind, context)
    for was, by, now in zip(old, g, (m.context, m.target, m.place, m.bias), strict=True):
        assert np.allclose(now, was - language_model.RATE * by / np.sqrt(0.1 + by * by), atol=1e-4)


@pytest.mark.parametrize("article", [False, True])
def test_html_shares_over_the_whole_host(spark, article):
    draw = random.Random(5)
    some = [" ".join(draw.choices("abcdefg", k=k)) for k in (1, 1, 2, 2, 3, 5, 6)]
    rows = []
    for k in range(40):
        blocks = [draw.choice(some) if draw.random() < 0.6 else f"own {k} " + "x " * draw.randint(1, 4) for _ in range(draw.randint(0, 9))] + ["a line most pages have"] * (k % 4 > 0)
        body = "".join(f"<p>{b}</p>" for b in blocks)
        rows.append((k, f"http://h/{k}", f"<article>{body}</article>" if article and k % 3 else body))
    pages = spark.createDataFrame(rows + rows[:3], "page_id long, url string, html string")
    whole, dealt = (sorted(map(tuple, html_text.main_text(pages, pages_a_shard=n).collect())) for n in (256, 4))
    assert dealt == whole and not any("a line most" in text for _, _, text in dealt)
