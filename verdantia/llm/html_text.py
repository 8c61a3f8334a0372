"""Main text of HTML pages, with a suffix array over each host's pages.

A page is read into blocks (runs of text between block-level tags, references decoded, white space collapsed). Scripts,
menus, headers, footers, sidebars, notices, adverts, forms and reader comments go by their elements, or by the words of
their class, id or role. Words that articles use for themselves as well (``search-results``, ``related-work``) are a hint only:
such blocks stay unless the host's pages share them. Where a page marks its article (article, main), blocks outside it go as well.

What is left is compared over the host: the pages' blocks, as tokens, are concatenated, and a suffix array with common
prefix lengths finds the runs of at least ``LEAST_WORDS`` words that distinct pages share. Blocks so covered are
boilerplate and go, unique runs stay: on pages without a marked article, and where a class word hints at it, from two pages on;
inside a marked article (where copied passages are text) only from ``LEAST_PAGES`` pages and more than half of all those compared.

A host's pages lie in shards of about ``PAGES`` pages each, so that a host with a third of all pages is dealt over many
tasks; a smaller host is one shard. The list of hosts that need more than one shard is bounded by ``LARGE_HOSTS``: shards
grow until it fits. What pages share is found over the whole host all the same: a block is covered by a shared run if and
only if it is by a shared run of ``LEAST_WORDS`` words that cannot be made shorter around it, which has at most that many
blocks. The distinct pages of these least runs (as 64-bit hashes) are counted over all shards of a large host, and each
shard gets the counts of the runs it has.

Defined cases: null and empty pages have an empty text; pages with a null or odd url form the host ````; repeated rows of
one page_id and url count as one page and each get the text; broken markup is read as it stands (an unclosed element ends with its parent);
an empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, shuffle_partitions, table

PAGES = 256
LARGE_HOSTS = 50_000
LEAST_WORDS = 4
LEAST_PAGES = 8

_RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|object|select|xmp|noframes"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*>|<[!?/][^>]*>",
    re.S | re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_DROPPED = frozenset("nav footer aside form button head menu dialog".split())
#: Words of class, id or role that mark what is no part of the article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar complementary footer contentinfo masthead cookie cookies consent gdpr popup modal overlay comment comments commentlist disqus replies share sharing newsletter subscribe subscription signup login toolbar pagination pager".split()
)
#: Words that do so by themselves; within a longer name they are a hint.
_HINTS = frozenset("banner aside notice notices reply respond social related recommended widget widgets search skip".split())
#: Kinds of blocks.
OUTSIDE, INSIDE, HINT_INSIDE, HINT_OUTSIDE = range(4)
_ATTR = re.compile(r"\b(class|id|role|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CLOSES_P = _BLOCK - {"option", "optgroup", "body", "html", "head"}


def _marks(attrs: str) -> tuple[bool, bool, bool]:
    """(no part of the article, perhaps none, the article's own element)"""
    out = hint = main = False
    for name, a, b, c in _ATTR.findall(attrs):
        value, name = (a or b or c).lower(), name.lower()
        out |= name == "hidden" and value != "until-found"
        if name != "hidden":
            words = re.split(r"[^a-z0-9]+", value)
            out |= not _MARKS.isdisjoint(words) or not _HINTS.isdisjoint(value.split())
            hint |= not _HINTS.isdisjoint(words)
            main |= name == "role" and value == "main"
    return out, hint, main


def read_blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of a page's blocks, those of dropped elements left out."""
    if not page:
        return []
    blocks: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, dropped, inside, hint
    at, dropped, inside, hint = 0, False, False, False

    def flush() -> None:
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                blocks.append((text, (HINT_INSIDE if hint else INSIDE) if inside else HINT_OUTSIDE if hint else OUTSIDE))
            parts.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > at and not dropped:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif not dropped and tag in ("br", "wbr"):
                parts.append(" " if tag == "br" else "")
            continue
        if tag in _BLOCK:
            flush()
        if m["close"]:
            if any(s[0] == tag for s in stack):
                while stack and stack.pop()[0] != tag:
                    pass
                _, dropped, inside, hint = stack[-1] if stack else ("", False, False, False)
        elif not m["attrs"].rstrip().endswith("/") or tag in _BLOCK:
            if tag in _CLOSES_P and any(s[0] == "p" for s in stack) and not any(s[0] in ("table", "td", "button") for s in stack[[s[0] for s in stack].index("p") :]):
                while stack.pop()[0] != "p":
                    pass
                _, dropped, inside, hint = stack[-1] if stack else ("", False, False, False)
            out, perhaps, main = _marks(m["attrs"]) if m["attrs"] else (False, False, False)
            out |= tag in _DROPPED or (tag == "header" and not inside)
            stack.append((tag, dropped or (out and tag not in ("html", "body")), inside or main or tag in ("article", "main"), hint or (perhaps and tag not in ("html", "body"))))
            _, dropped, inside, hint = stack[-1]
    if at < len(page) and not dropped:
        parts.append(page[at:])
    flush()
    return blocks


# ---------------------------------------------------------------- the host's suffix array
def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, common prefix length with the one before) by prefix doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:] if step < n else []
        order = np.lexsort((after, rank))
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]]))
        rank = new
        if n == 0 or rank[order[-1]] == n - 1 or step >= n:
            break
        step *= 2
    lcp, h = np.zeros(n, np.int64), 0
    place = rank.tolist()
    sa, t, out = order.tolist(), tokens.tolist(), [0] * n
    for i in range(n):
        if place[i]:
            j = sa[place[i] - 1]
            while i + h < n and j + h < n and t[i + h] == t[j + h]:
                h += 1
            out[place[i]] = h
            h = max(h - 1, 0)
        else:
            h = 0
    lcp[:] = out
    return order, lcp


def shared_lengths(order: np.ndarray, lcp: np.ndarray, page: np.ndarray, least: int) -> np.ndarray:
    """For every position: the length of the longest substring from there that starts on at least ``least`` distinct pages."""
    n = len(order)
    best = np.zeros(n, np.int64)
    held: dict[int, int] = defaultdict(int)
    low: deque[int] = deque()  # indices of ascending lcp within the window
    left, distinct, windows = 0, 0, []
    owners, l_list = page[order].tolist(), lcp.tolist()
    for right in range(n):
        if right:
            while low and l_list[low[-1]] >= l_list[right]:
                low.pop()
            low.append(right)
        held[owners[right]] += 1
        distinct += held[owners[right]] == 1
        while distinct >= least:
            while low and low[0] <= left:
                low.popleft()
            if low and l_list[low[0]] > 0:
                windows.append((left, right, l_list[low[0]]))
            held[owners[left]] -= 1
            distinct -= held[owners[left]] == 0
            left += 1
        if left and low and l_list[low[0]] > 0:  # a page seen before ends a window as well
            best[order[right]] = max(best[order[right]], l_list[low[0]])
    for a, b, k in windows:  # each window's minimum holds for all its suffixes
        part = best[order[a : b + 1]]
        best[order[a : b + 1]] = np.maximum(part, k)
    return best


def least_pages(kind: int, pages: int) -> int:
    """The pages that have to share a block of this kind for it to go."""
    return max(LEAST_PAGES, pages // 2 + 1) if kind == INSIDE else 2


def boilerplate(pages: list[list[tuple[int, int, int]]]) -> list[set[int]]:
    """For each page of one host, given its blocks' (hash, words, kind): the blocks that shared runs cover."""
    out: list[set[int]] = [set() for _ in pages]
    if len(pages) < 2:
        return out
    tokens, owner, words, kinds = [], [], [], []
    for k, blocks in enumerate(pages):
        for h, n, i in blocks:
            tokens.append(h)
            owner.append(k)
            words.append(n)
            kinds.append(i)
        tokens.append(-1 - k)  # no run crosses pages
        owner.append(k)
        words.append(0)
        kinds.append(OUTSIDE)
    order, lcp = suffix_array(np.array(tokens, np.int64))
    page, size = np.array(owner), np.concatenate([[0], np.cumsum(words)])
    first = np.concatenate([[0], np.cumsum([len(b) + 1 for b in pages])])
    for least in {least_pages(k, len(pages)) for k in kinds}:
        if least > len(pages):
            continue
        length = shared_lengths(order, lcp, page, least)
        for at in np.flatnonzero(length):
            if size[at + length[at]] - size[at] >= LEAST_WORDS:
                k = owner[at]
                out[k].update(b - int(first[k]) for b in range(int(at), int(at + length[at])) if least_pages(kinds[b], len(pages)) == least)
    return out


# ---------------------------------------------------------------- hosts of several shards
def stream(texts: list[str], kinds: list[int]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(the blocks compared, their (hash, words, kind)): all, or with a marked article those inside it"""
    own = {INSIDE, HINT_INSIDE}
    kept = [k for k in range(len(texts)) if own.isdisjoint(kinds) or kinds[k] in own]
    return kept, [(xxhash.xxh64_intdigest(texts[k]) >> 1, texts[k].count(" ") + 1, kinds[k]) for k in kept]


def least_runs(blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(hash, first, stop) of the runs of at least ``LEAST_WORDS`` words that are too short without their first or last block."""
    out = []
    for at in range(len(blocks)):
        size, key = 0, b""
        for stop in range(at + 1, len(blocks) + 1):
            h, n, _ = blocks[stop - 1]
            before, size, key = size, size + n, key + h.to_bytes(8, "little")
            if size >= LEAST_WORDS and (stop == at + 1 or min(before, size - blocks[at][1]) < LEAST_WORDS):
                out.append((xxhash.xxh64_intdigest(key) - (1 << 63), at, stop))
            if size - blocks[at][1] >= LEAST_WORDS and before >= LEAST_WORDS:
                break
    return out


def covered(blocks: list[tuple[int, int, int]], counts: dict[int, int], pages: int) -> set[int]:
    """The blocks that shared runs cover, given the distinct pages of the host's shared runs and the host's pages."""
    return {k for h, at, stop in least_runs(blocks) for k in range(at, stop) if counts.get(h, 1) >= least_pages(blocks[k][2], pages)}


# ---------------------------------------------------------------- the operator
def main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html", pages_a_shard: int = PAGES) -> DataFrame:
    """(page_id, url, text) of every row."""
    host = F.coalesce(F.regexp_extract(F.lower(column(url)), r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    rows = pages.select(column(page_id).alias("page_id"), column(url).cast("string").alias("url"), column(page).cast("string").alias("html"), host.alias("host"))
    counts = rows.groupBy("host").agg(F.count("*").alias("n"))
    size = pages_a_shard
    while counts.filter(F.col("n") > size).count() > LARGE_HOSTS:
        size *= 4
    large = {r.host: -(-r.n // size) for r in counts.filter(F.col("n") > size).collect()}  # at most LARGE_HOSTS
    of_large = rows.join(F.broadcast(counts.filter(F.col("n") > size).select("host")), "host", "left_semi")
    distinct = {r.host: r.n for r in of_large.select("host", "page_id", "url").distinct().groupBy("host").agg(F.count("*").alias("n")).collect()} if large else {}
    sent = pages.sparkSession.sparkContext.broadcast((large, distinct))
    kind = rows.schema["page_id"].dataType.simpleString()

    def read(batches):
        large, _ = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                ids, urls, hosts = b.column(0), b.column(1).to_pylist(), b.column(3).to_pylist()
                blocks = [read_blocks(x) for x in b.column(2).to_pylist()]
                shard = [f"{h} {xxhash.xxh64_intdigest(repr((i, u))) % large.get(h, 1)}" for h, i, u in zip(hosts, ids.to_pylist(), urls, strict=True)]
                texts = pa.array([[t for t, _ in x] for x in blocks], pa.list_(pa.string()))
                inside = pa.array([[i for _, i in x] for x in blocks], pa.list_(pa.int8()))
                yield pa.RecordBatch.from_arrays([pa.array(shard), ids, b.column(1), texts, inside], names=["shard", "page_id", "url", "blocks", "inside"])

    def runs(batches):
        large, _ = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[tuple[str, int, int, int]] = []
                for i, u, page, h in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    key, blocks = xxhash.xxh64_intdigest(repr((i, u))), read_blocks(page)
                    own = stream([t for t, _ in blocks], [x for _, x in blocks])[1]
                    out += [(h, key % large[h], key - (1 << 63), r) for r in {r for r, _, _ in least_runs(own)}]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["host", "part", "page", "run"])

    def clean(group: pa.Table, shared: pa.Table | None = None) -> pa.Table:
        large, distinct = sent.value
        texts, inside = group.column("blocks").to_pylist(), group.column("inside").to_pylist()
        keys = list(zip(group.column("page_id").to_pylist(), group.column("url").to_pylist(), strict=True))
        number = {k: n for n, k in enumerate(dict.fromkeys(keys))}
        streams: list = [[] for _ in number]
        kept = []
        for key, t, i in zip(keys, texts, inside, strict=True):
            own, blocks = stream(t, i)
            kept.append(own)
            if not streams[number[key]]:
                streams[number[key]] = blocks
        host = group.column("shard")[0].as_py().rpartition(" ")[0]
        if host in large:
            known = dict(zip(shared.column("run").to_pylist(), shared.column("n").to_pylist(), strict=True))
            gone = [covered(blocks, known, distinct[host]) for blocks in streams]
        else:
            gone = boilerplate(streams)
        out = []
        for key, t, own in zip(keys, texts, kept, strict=True):
            drop = gone[number[key]]
            out.append("\n\n".join(t[k] for n, k in enumerate(own) if n not in drop))
        return pa.table({"page_id": group.column("page_id"), "url": group.column("url"), "text": pa.array(out, pa.string())})

    parts, result = shuffle_partitions(pages.sparkSession), f"page_id {kind}, url string, text string"
    read_rows = rows.mapInArrow(read, f"shard string, page_id {kind}, url string, blocks array<string>, inside array<tinyint>")
    by_shard = read_rows.repartition(parts, "shard").groupBy("shard")
    if not large:
        return by_shard.applyInArrow(lambda group: clean(group), result)
    # A run has at most a shard's pages in one (host, part), so that no task gets all pages of a frequent one.
    found = of_large.select("page_id", "url", "html", "host").mapInArrow(runs, "host string, part int, page long, run long")
    of_part = found.repartition(parts, "host", "part", "run").distinct().groupBy("host", "part", "run").agg(F.count("*").alias("n"))
    of_host = of_part.groupBy("host", "run").agg(F.sum("n").alias("n"), F.collect_list("part").alias("part")).filter("n > 1")
    shared = of_host.select("host", F.explode("part").alias("part"), "run", "n").select(F.concat_ws(" ", "host", "part").alias("shard"), "run", "n")
    return by_shard.cogroup(shared.repartition(parts, "shard").groupBy("shard")).applyInArrow(lambda group, shared: clean(group, shared), result)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = main_text(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
