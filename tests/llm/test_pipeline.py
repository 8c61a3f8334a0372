import hashlib
import re
from collections import Counter

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, DATA).columns == docs.columns


def test_encoding_leaves_no_large_plans_with_the_driver(spark):
    """The driver keeps the text of each plan that ran; those with the ranks in them had 12 MB."""
    runs = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    old = {runs().apply(k).executionId() for k in range(runs().size())}
    assert corpus_pipeline.encoding(spark, spark.read.parquet(f"{DATA}/documents.parquet").limit(20), DATA).count() == 20
    new = [runs().apply(k) for k in range(runs().size()) if runs().apply(k).executionId() not in old]
    assert new and max(len(x.physicalPlanDescription()) for x in new) < 3_000_000


# ---------------------------------------------------------------- the chain in plain Python
def _good(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(n - 7)]
    seen = Counter(windows)
    repeated = len({k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(8)})
    upper, twice = sum(c.isupper() for c in text), len(lines) - len(set(lines))
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = n < 20 or 100 * repeated > 30 * n or 10 * symbols > n or 10 * upper > 3 * chars
    return not (failed or (twice >= 3 and 2 * twice > len(lines)) or chars < 2 * n or chars > 12 * n)


def _unique(docs):
    """The smallest id of each component of 5-word sets with a similarity of 0.8 or more."""
    sets = {}
    for i, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: docs[i] for i in ids if find(i) == i}


def _without_repeats(docs):
    data = {i: t.encode() for i, t in docs.items()}
    seen = Counter(hashlib.blake2b(d[k : k + 200], digest_size=12).digest() for d in data.values() for k in range(len(d) - 199))
    out = {}
    for i, d in data.items():
        gone = bytearray(len(d))
        for k in range(len(d) - 199):
            if seen[hashlib.blake2b(d[k : k + 200], digest_size=12).digest()] > 1:
                gone[k : k + 200] = b"\1" * 200
        out[i] = bytes(c for c, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _clean(docs, items):
    windows = {}
    for item in map(_words, items):
        size = min(10, len(item))
        windows.setdefault(size, set()).update(tuple(item[k : k + size]) for k in range(len(item) - size + 1))
    windows.pop(0, None)

    def hit(text):
        w = _words(text)
        return any(tuple(w[k : k + size]) in own for size, own in windows.items() for k in range(len(w) - size + 1))

    return {i: t for i, t in docs.items() if not hit(t)}


def test_run_equals_brute_force(spark):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = _clean(_without_repeats(_unique({r.doc_id: r.text for r in rows if _good(r.text)})), items)
    bpe = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for i, text in kept.items():
        ids = bpe.encode_ordinary(text)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert 0 < len(got) < len(rows)
    assert got == want


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, null ids and texts, repeated rows, a long text, other columns: every stage keeps the columns of documents."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, quality int"
    long = " ".join(f"word{k} goes on and" for k in range(60_000))
    some = " ".join(f"this is text number {k} of it" for k in range(12))
    rows = [(None, some), (None, some), (1, None), (2, ""), (3, long), (3, long)]
    spark.createDataFrame([(1, "a b c"), (None, "x y z"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "r", 1) for i, t in rows], kind)
    for given in (docs, docs.filter("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= given.count()
        assert corpus_pipeline.STAGES[-1][1](spark, given, str(tmp_path)).count() == given.count()
    left = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "2", "3", "None"]
