"""Main text of web pages by nearest-URL page differencing, with structure as protection and as the check after it.

A page becomes lines (blocks of text), menus and footers included. If it has an `article` or `main` element, the
headings, paragraphs, list items, cells and quotes inside are settled: they are main text, though other pages share
them. Lines inside menus, headers, footers, sidebars, notices, adverts, forms, comments and the like, known by tag,
role or class, and those outside the article are marked. All other lines are open, and so are those inside an article
whose only mark is one part of a compound class name (`social-policy`), which may mean anything.

Each page is paired with the page of its host whose URL path is nearest: pages are sorted by host, path and id, and
of the nearest page before and the nearest after it with other lines the one with the longer common prefix is taken
(ties: the earlier one; pages with the same lines are passed over, since a copy tells nothing). Both pages' lines are
aligned by longest common subsequence, and lines that the alignment shares are deleted unless they are settled. Of
what is left, marked lines go too: an advert that only one page has is no main text either. Sorting is by ranges; to
each the nearest pages outside it with other lines than its edge rows are added, so a host with a third of all pages is
spread over many tasks and the result does not depend on the ranges.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .arrowtext import U, buffers, mix, prefix_hash, span_hash, tidy

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|select|object|xmp)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
SPACES = re.compile(r"[ \t\n\r\f\v]+|\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
SETTLED = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th caption blockquote pre figcaption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("nav footer aside form menu dialog button label head fieldset frameset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion promotions banner cookie cookies consent gdpr notice notices notification newsletter subscribe subscription signup login sidebar comment comments disqus replies menu nav navbar navigation breadcrumb breadcrumbs footer header share sharing social related recommended popup modal overlay toolbar pagination pager widget widgets skip".split()
)
CLOSES_P = BLOCK - {"html", "body", "option"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("table ul ol dl article section div main aside nav".split())

#: in a compound class name inside an article these tell nothing for sure: entry-header, social-policy, menu-plan
VAGUE = frozenset("header social notice notices notification banner menu share sharing promotion promotions related recommended widget widgets skip login signup subscription alert toolbar overlay modal".split())

OPEN, KEEP, MARKED = 0, 1, 2
NO_ID = -(1 << 63)  # null ids sort first
HELD = 4_000_000  # characters of texts that a task holds before it passes them on


def _judge(tag: str, attr: str, inside: bool) -> int:
    """MARKED if an element is no main text, OPEN if its name leaves that open, else KEEP; `inside`: an article or main
    element is open."""
    if tag in DROPPED or (tag == "header" and not inside):
        return MARKED
    found = KEEP
    if not attr or tag in ("html", "body"):
        return found
    for name, value in ATTRIBUTE.findall(attr):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return MARKED
        if name == "role" and value in ROLES:
            return MARKED
        if name in ("class", "id") and tag not in HEADING | {"article", "main"}:
            for word in value.split():
                parts = re.split(r"[^a-z0-9]+", word)
                hit = NAMES.intersection(parts)
                if hit and inside and len(parts) > 1 and hit <= VAGUE:
                    found = OPEN
                elif hit:
                    return MARKED
        if name == "class" and tag == "article" and not {"comment", "comments", "ad", "advert", "sponsored", "promo", "related"}.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return MARKED
    return found


def lines(page: str) -> list[tuple[str, int]]:
    """(text, KEEP, OPEN or MARKED) of each block, in page order."""
    found: list[tuple[str, int, bool]] = []  # text, state, inside
    stack: list[tuple[str, int, bool]] = []  # tag, what names around it say, inside
    text: list[str] = []
    any_inside = False

    def flush() -> None:
        if text:
            line = SPACES.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if line:
                block = next((t for t, _, _ in reversed(stack) if t in BLOCK), "")
                names, inside = (stack[-1][1], stack[-1][2]) if stack else (KEEP, False)
                if names == MARKED or (block not in HEADING and any(t == "header" for t, _, _ in stack)):
                    state = MARKED
                else:
                    state = KEEP if inside and (block in HEADING or (block in SETTLED and names == KEEP)) else OPEN
                found.append((line, state, inside))

    def pop_to(k: int) -> None:
        if any(t in BLOCK or (names == MARKED and (i == 0 or stack[i - 1][1] != MARKED)) for i, (t, names, _) in enumerate(stack[k:], k)):
            flush()
        del stack[k:]

    last = 0
    for m in TOKEN.finditer(page):
        if m.start() > last:
            text.append(page[last : m.start()])
        last = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if k >= 0:
                pop_to(k)
            elif tag in BLOCK:
                flush()
            continue
        if tag in CLOSES_P:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in FENCES or stack[i][0] == "p"), -1)
            if k >= 0 and stack[k][0] == "p":
                pop_to(k)
        if tag in SIBLINGS:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in FENCES or stack[i][0] in SIBLINGS[tag]), -1)
            if k >= 0 and stack[k][0] in SIBLINGS[tag]:
                pop_to(k)
        if tag in VOID:
            if tag == "br":
                text.append(" ")
            elif tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
        names, inside = (stack[-1][1], stack[-1][2]) if stack else (KEEP, False)
        says = MARKED if names == MARKED else _judge(tag, m["attr"], inside)
        if says == MARKED and names != MARKED:
            flush()
        if tag in ("article", "main") and says != MARKED:
            inside = any_inside = True
        if not m["attr"].endswith("/"):
            stack.append((tag, OPEN if says == KEEP and names == OPEN else says, inside))
    if last < len(page):
        text.append(page[last:])
    flush()
    return [(t, state if inside or not any_inside else MARKED) for t, state, inside in found]


def _rows(a: list[int], b: list[int]) -> np.ndarray:
    """For each i the length of the longest common subsequence of a[:i] and b, bit-parallel."""
    masks: dict[int, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        m = masks.get(c)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared(a: list[int], b: list[int]) -> list[bool]:
    """Which items of `a` a longest common subsequence with `b` uses. Equal ends are matched first, then halves of `b`
    are aligned apart where the sum of both is longest, so memory grows with the lines and not with their square."""
    used = [False] * len(a)
    todo = [(list(enumerate(a)), b)]
    while todo:
        left, right = todo.pop()
        lo = 0
        while lo < min(len(left), len(right)) and left[lo][1] == right[lo]:
            used[left[lo][0]] = True
            lo += 1
        n, m = len(left), len(right)
        while n > lo and m > lo and left[n - 1][1] == right[m - 1]:
            n, m = n - 1, m - 1
            used[left[n][0]] = True
        # only lines that both have can be shared
        mine, theirs = {x for _, x in left[lo:n]}, set(right[lo:m])
        left, right = [x for x in left[lo:n] if x[1] in theirs], [y for y in right[lo:m] if y in mine]
        if not left:
            continue
        if len(right) == 1:
            used[left[0][0]] = True
            continue
        half, values = len(right) // 2, [x for _, x in left]
        total = _rows(values, right[:half]) + _rows(values[::-1], right[half:][::-1])[::-1]
        cut = int(np.argmax(total))
        todo += [(left[:cut], right[:half]), (left[cut:], right[half:])]
    return used


def place(url: str | None) -> tuple[str, str]:
    """(host, path with query) of a URL; text that is no URL is a path of the empty host."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or ""), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        return "", url or ""


ROW = "rid long, page_id long, url string, host string, path string, bucket int, body binary, states binary, hashes binary"


def _parse(cuts: list[tuple[str, str, int]]):
    """Lines of pages: their states, hashes, and compressed texts, those of marked lines left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        press = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for page_id, url, page in zip(*(batch.column(k) for k in range(3)), strict=True):
                found = lines(page.as_py() or "")
                host, path = place(url.as_py())
                raw, offsets, _ = buffers(pa.array([t for t, _ in found], pa.large_string()))
                h = mix(span_hash(prefix_hash(raw), offsets[:-1], offsets[1:]) + U(1))
                body = press.compress("\n".join(t for t, state in found if state != MARKED).encode())
                row = [rid, page_id.as_py(), url.as_py(), host, path, bisect.bisect_right(cuts, (host, path, NO_ID if page_id.as_py() is None else page_id.as_py())), body, bytes(s for _, s in found), h.tobytes()]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                rid += 1
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in ROW.split(", ")])

    return run


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pages in order, their text and numbers of lines. Holds the lines of three pages at a time, and keys and URLs
    of a run of pages with the same lines; a run's bodies are held once and compressed until their turn."""
    press = zstandard.ZstdDecompressor()

    def runs():
        run = None
        names = ("page_id", "url", "host", "path", "bucket", "body", "states", "hashes", "ghost")
        for batch in batches:
            for page_id, url, host, path, bucket, body, states, hashes, ghost in zip(*(batch.column(c) for c in names), strict=True):
                host, path, bucket, hashes = host.as_py(), path.as_py(), bucket.as_py(), hashes.as_py()
                if run is None or run["key"] != (bucket, host, hashes):
                    if run:
                        yield run
                    run, same = {"key": (bucket, host, hashes), "first": path, "pages": []}, {}
                run["last"] = path
                if not ghost.as_py():
                    pair = (body.as_py(), states.as_py())
                    run["pages"].append((page_id.as_py(), url.as_py(), path, *same.setdefault(pair, pair)))
        if run:
            yield run

    def decided(before, run, after):
        bucket, host, hashes = run["key"]
        mine = np.frombuffer(hashes, np.uint64).tolist()
        near = [(x, path) for x, path in ((before, before and before["last"]), (after, after and after["first"])) if x and x["key"][:2] == (bucket, host)]
        uses: dict[int, list[bool]] = {}  # all pages of the run have the same lines
        for page_id, url, path, body, states in run["pages"]:
            used = [False] * len(mine)
            if near:
                k = max(range(len(near)), key=lambda k: _common(near[k][1], path))
                if k not in uses:
                    uses[k] = shared(mine, np.frombuffer(near[k][0]["key"][2], np.uint64).tolist())
                used = uses[k]
            texts = press.decompress(body).decode().split("\n")
            stays = [s == KEEP or not u for s, u in zip(states, used, strict=True) if s != MARKED]
            text = "\n".join(t for t, stay in zip(texts, stays, strict=False) if stay)
            gone = sum(u and s != KEEP for s, u in zip(states, used, strict=True))
            marked = sum(not u and s == MARKED for s, u in zip(states, used, strict=True))
            yield page_id, url, text, len(states), gone, marked

    def pack(done):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*done, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "text", "n_lines", "n_shared", "n_marked"])

    done: list[tuple] = []
    size = 0
    window: list = [None, None]
    for run in itertools.chain(runs(), [None]):
        if window[1]:
            for d in decided(window[0], window[1], run):
                done.append(d)
                size += len(d[2])
                if size >= HELD:
                    yield pack(done)
                    done, size = [], 0
        window = [window[1], run]
    yield pack(done)


def _beyond(edges: list, step: int) -> list[tuple[int, int]]:
    """(bucket, rid) of the nearest page before (step -1) or after (step 1) each range whose lines or host differ from
    those of the range's edge row. `edges`, by bucket: first and last row, and the rids of the rows next to them that
    differ from them, null if none does."""
    out = []
    for k, e in enumerate(edges):
        mine, j = e["first" if step < 0 else "last"]["sig"], k + step
        while 0 <= j < len(edges):
            side = "last" if step < 0 else "first"
            if edges[j][side]["sig"] != mine:
                out.append((e["bucket"], edges[j][side]["rid"]))
                break
            if edges[j][f"{side}_other"] is not None:
                out.append((e["bucket"], edges[j][f"{side}_other"]))
                break
            j += step
    return out


def differences(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", ranges: int | None = None) -> DataFrame:
    """page_id, url, text, n_lines, n_shared, n_marked for every row: how many lines a page has, how many of them went
    because the nearest page shares them, and how many more went by their marks. See `extract`."""
    spark = pages.sparkSession
    scratch.small_batches(spark)
    ranges = ranges or 2 * scratch.partitions(spark)
    # cut points only balance the ranges: a few URLs for each range; ids part the copies of one URL
    n = max(1, pages.count())
    some = pages.where(F.pmod(F.xxhash64(key, url), F.lit(max(1, n // (40 * ranges)))) == 0).select(F.col(url), F.col(key).cast("long")).limit(100 * ranges).collect()
    places = sorted((*place(r[0]), NO_ID if r[1] is None else r[1]) for r in some)
    cuts = sorted({places[len(places) * i // ranges] for i in range(1, ranges)}) if places else []
    rows = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(page)).mapInArrow(tidy(_parse(cuts)), ROW)
    rows = scratch.table(rows, "pages").withColumn("ghost", F.lit(False))
    # a run of equal pages may cross ranges: of each range its edge rows, and the rows nearest to these that differ
    sig = rows.select("bucket", "rid", F.struct("host", "path", "page_id", "rid").alias("o"), F.xxhash64("host", "hashes").alias("sig"))
    row = F.struct("rid", "sig")
    edges = scratch.table(sig.groupBy("bucket").agg(F.max_by(row, "o").alias("last"), F.min_by(row, "o").alias("first")), "edges")
    # one row a range
    other = sig.join(F.broadcast(edges), "bucket").groupBy("bucket")
    other = other.agg(F.max(F.when(F.col("sig") != F.col("last.sig"), F.col("o")))["rid"].alias("last_other"), F.min(F.when(F.col("sig") != F.col("first.sig"), F.col("o")))["rid"].alias("first_other"))
    found = edges.join(other, "bucket").orderBy("bucket").collect()
    beyond = spark.createDataFrame(_beyond(found, -1) + _beyond(found, 1), "to int, rid long")
    ghosts = rows.join(F.broadcast(beyond), "rid")
    blank = {"bucket": F.col("to"), "ghost": F.lit(True), "body": F.lit(None).cast("binary")}
    ghosts = ghosts.select(*[blank.get(c, F.col(c)).alias(c) for c in rows.columns])
    order = ["bucket", "host", "path", "page_id", "rid"]
    return rows.unionByName(ghosts).repartition("bucket").sortWithinPartitions(*order).mapInArrow(tidy(_differences), "page_id long, url string, text string, n_lines long, n_shared long, n_marked long")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", ranges: int | None = None) -> DataFrame:
    """page_id, url, text for every row; text is empty for null, empty and text-less pages.

    Null URLs are pages of the empty host. Repeated rows are pages of their own; rows with one URL are ordered by id,
    then arbitrarily, and equal lines there make no difference. An empty table gives no rows.
    """
    return differences(pages, key, url, page, ranges).select("page_id", "url", "text")


def op9_page_differencing(spark, sf_dir: str) -> DataFrame:
    out = differences(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared", "n_marked")
