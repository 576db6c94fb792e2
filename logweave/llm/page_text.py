"""Main text of web pages by differencing with the page of the nearest URL (op 8).

Each page becomes a list of text lines (one a block) with the place each has in the markup.
The paths of a host are put in order, and each is paired with the neighbour that shares the
longer piece of path (query, fragment, closing slash and file ending aside, so that variants of
one address are no pair).  The lines of a page and of its partner are aligned by longest common
subsequence and those that both have are deleted: what a site repeats is not the article.

Two things are known from the markup itself.  Lines of elements that never hold the article
(navigation, headers, footers, sidebars, notices, adverts, forms, comment sections, scripts and
styles) go without a comparison; a class, id or form may be a wrapper's, so it removes no article
of a page that has no other, and not all of a page.  Lines inside an article or main element need more evidence
than one partner, and the same for all pages of a host.  Differencing only proposes them: a line is
proposed if two of a page's four nearest paths in order have it and neither those two nor the page with
one of them are near copies, that is, share half of the shorter article's characters (mirrored or partly
copied articles are in one another's neighbourhood).  A proposed line goes, on every page of the
host, if at least half of the host's paths have it in their articles; else it stays on all of them.
Article lines are compared with article lines, all others with the partner's others.

Scale: hosts are not groups here.  Paths are ranked by (host, path) with a range partition, so a
host with a third of all pages spreads over many tasks; neighbours meet in buckets of ranks that
overlap by two, and only hashes of lines travel.  Lines are counted over a host's paths only where they
were proposed.  What a host loses is a short list: lines that half of its paths have are at most twice as
many as an article has on average.  Pages are parsed twice, so that their text is moved once, to what
their path is compared with.

Defined results: null html has no text; a null url is a host of its own with an empty path; a
path is represented by its row with the smallest page_id; a page alone on its host loses no line
by differencing, nor does one that would lose all it has (a copy of its partner tells nothing
apart), and a host of two paths loses no article line; a line's length counts as 2^24 - 1 characters
at most; repeated rows each keep a row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, rows_of

#: Elements by what they are to the text.
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search
section select summary table tbody td template tfoot th thead title tr ul""".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REMOVED = frozenset("nav header footer aside form menu dialog button select fieldset head".split())
CONTENT = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words of class and id names that mark what is no article.
MARKS = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion breadcrumb
breadcrumbs comment comments respond disqus cookie cookies consent gdpr notice notification alert popup modal overlay menu
menus nav navbar navigation header masthead footer sidebar widget widgets related recommended share sharing social
newsletter subscribe signup login search pagination pager toolbar skip""".split())
#: A closing tag of these also ends an open paragraph; an opening one does too.
CLOSES_P = BLOCKS - frozenset("body html head title option optgroup legend summary".split())

_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}

GONE, OPEN, KEPT = 0, 1, 2
#: While a page is read: below a mark that may belong to a wrapper, and an article below such a mark.
MARKED, FOUND = 3, 4


def _removal(name: str, attributes: str) -> int | None:
    """GONE or MARKED where markup speaks against an element; a class or id name counts by its first word."""
    if name in REMOVED and name != "form":
        return GONE
    found = MARKED if name == "form" else None
    if not attributes or name in ("html", "body", *CONTENT):
        return found
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return GONE
        if key == "role" and value in ROLES:
            return GONE
        if key in ("class", "id") and any(re.split(r"[^a-z0-9]+", token.lstrip("-_"))[0] in MARKS for token in value.split()):
            found = MARKED
    return found


def _state(above: int, name: str, attributes: str) -> int:
    removal = GONE if above == GONE else _removal(name, attributes)
    if removal == GONE or removal == MARKED and above in (KEPT, FOUND):
        return GONE
    if above == MARKED or removal == MARKED:
        return FOUND if name in CONTENT else MARKED
    return KEPT if above == OPEN and name in CONTENT else above


def _settled(lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Articles below marks count if the page has no other; without any line left, what marks alone removed is undecided."""
    states = {state for state, _ in lines}
    found = GONE if KEPT in states else KEPT
    marked = GONE if not states.isdisjoint((OPEN, KEPT, FOUND)) else OPEN
    return [({FOUND: found, MARKED: marked}.get(state, state), text) for state, text in lines]


def lines_of(page: str) -> list[tuple[int, str]]:
    """(state, text) of a page's blocks in order: removed by markup, undecided, or article."""
    lines: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = [("", OPEN)]

    def end_block() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            lines.append((stack[-1][1], text))

    def close(name: str) -> None:
        depth = len(stack) - 1
        while depth and stack[depth][0] != name:
            depth -= 1
        if depth:
            if any(n in BLOCKS for n, _ in stack[depth:]):
                end_block()
            del stack[depth:]

    at, size = 0, len(page)
    while at < size:
        tag = _TAG.search(page, at)
        if tag is None:
            held.append(page[at:])
            break
        if tag.start() > at:
            held.append(page[at:tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:  # a comment, doctype or the like
            continue
        if tag[1]:
            if name == "br":
                held.append(" ")
            else:
                close(name)
            continue
        if name in RAW and not tag[4]:
            stop = _ENDS[name].search(page, at)
            at = stop.end() if stop else size
            if name in BLOCKS:
                end_block()
            continue
        if name in VOID or tag[4]:
            if name in BLOCKS:
                end_block()
            else:
                held.append(" " if name == "br" else "")
            continue
        if name in CLOSES_P:
            _end_paragraph(stack, end_block)
        if name in BLOCKS:
            end_block()
        if name in ("li", "option", "dt", "dd", "tr", "td", "th"):
            _end_sibling(stack, name, end_block)
        above = stack[-1][1]
        state = _state(above, name, tag[3])
        if name not in BLOCKS and state != above:
            end_block()
        stack.append((name, state))
    end_block()
    return _settled(lines)


def _end_paragraph(stack: list[tuple[str, int]], end_block) -> None:
    """An open paragraph ends where another block begins; what was open inside ends with it."""
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth][0] == "p":
            end_block()
            del stack[depth:]
            return
        if stack[depth][0] in BLOCKS:
            return


def _end_sibling(stack: list[tuple[str, int]], name: str, end_block) -> None:
    alike = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
    outer = {"li": ("ul", "ol", "menu"), "tr": ("table", "tbody", "thead", "tfoot")}.get(name, ("table", "tr", "dl", "select"))
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth][0] in alike:
            end_block()
            del stack[depth:]
            return
        if stack[depth][0] in outer:
            return


def common(a: list[int], b: list[int]) -> list[int]:
    """Positions of ``a`` in a longest common subsequence of ``a`` and ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner, other = a[head:len(a) - tail], b[head:len(b) - tail]
    # Bit-parallel: bit j of a row is 0 where the length grows at position j of ``other``.
    places: dict[int, int] = {}
    for j, x in enumerate(other):
        places[x] = places.get(x, 0) | 1 << j
    full, rows = (1 << len(other)) - 1, []
    row = full
    for x in inner:
        rows.append(row)
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    found, j = [], len(other)
    rows.append(row)

    def length(i: int, upto: int) -> int:
        return upto - (rows[i] & ((1 << upto) - 1)).bit_count()

    i, want = len(inner), length(len(inner), j) if other else 0
    while want:
        if length(i - 1, j) == want:
            i -= 1
        elif length(i, j - 1) == want:
            j -= 1
        else:
            i, j, want = i - 1, j - 1, want - 1
            found.append(i)
    return [*range(head), *(head + i for i in reversed(found)), *range(len(a) - tail, len(a))]


#: A line's hash holds its length in the lowest 24 bits, and above them whether it is an article's.
LENGTH, ARTICLE = 0xFFFFFF, 0x1000000


def line_hash(state: int, text: str) -> int:
    mixed = xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 25 << 25
    return (mixed | (ARTICLE if state == KEPT else 0) | min(len(text), LENGTH)) - (1 << 63)


def _addressed(pages: DataFrame) -> DataFrame:
    """One row a page: host, path and markup."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_replace(F.regexp_replace(bare, r"^[^/?#]*", ""), r"[?#].*$", "")
    path = F.regexp_replace(path, r"(?:/index)?(?:\.(?:html?|php|aspx?|jsp))?/*$", "")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))


def _left(page: str | None) -> list[tuple[int, str]]:
    return [(state, text) for state, text in lines_of(page or "") if state != GONE]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [[line_hash(*line) for line in _left(page)] for (page,) in rows_of([batch], "html")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("page_id", "host", "path")), pa.array(hashes, pa.list_(pa.int64()))],
            ["page_id", "host", "path", "hashes"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "host", "path"]
    for batch in batches:
        left = [_left(page) for (page,) in rows_of([batch], "html")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array([[text for _, text in page] for page in left], pa.list_(pa.string())),
             pa.array([[line_hash(*line) for line in page] for page in left], pa.list_(pa.int64()))],
            [*names, "lines", "hashes"])


def _ranked(paths: DataFrame) -> DataFrame:
    """``paths(host, path, hashes)`` with ``rank``, the place in order of host and path."""
    order = ["host", "path"]
    parts = max(1, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = materialise(
        paths.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "paths")
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return (numbered.join(F.broadcast(offsets), "part")
            .withColumn("rank", (F.col("offset") + F.col("place")).cast("long")).drop("part", "place", "offset"))


def _agreement(a: str, b: str) -> F.Column:
    """Characters that two paths share from their start; -1 without a partner."""
    shorter = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))),
                           lambda i: F.substring(F.col(a), F.lit(1), i) == F.substring(F.col(b), F.lit(1), i)))
    return F.when(F.col(b).isNull(), -1).when(shorter == 0, 0).otherwise(same)


#: Ranks that are compared in one group.
BUCKET = 4096


def partners(paths: DataFrame) -> DataFrame:
    """(host, path, hashes, partner_hashes, other_hashes) of the paths that have a neighbour on their host.

    ``other_hashes`` holds those of the two paths before and the two after that share a line with
    another of them; the rest are no evidence on any line.
    """
    place = F.col("rank") % BUCKET
    buckets = F.array_compact(F.array(F.lit(0), F.when(place < 2, -1), F.when(place >= BUCKET - 2, 1)))
    dealt = _ranked(paths).withColumn("guest", F.explode(buckets)).withColumn("bucket", F.floor(F.col("rank") / BUCKET) + F.col("guest"))
    order = Window.partitionBy("bucket").orderBy("rank")
    steps = {"before": -1, "after": 1, "before2": -2, "after2": 2}
    for name, step in steps.items():
        there = F.lag("host", -step).over(order) == F.col("host")
        dealt = dealt.withColumn(f"{name}_hashes", F.when(there, F.lag("hashes", -step).over(order)))
        if abs(step) == 1:
            dealt = dealt.withColumn(f"{name}_path", F.when(there, F.lag("path", -step).over(order)))
    nearer = _agreement("path", "before_path") >= _agreement("path", "after_path")
    found = F.when(F.col("before_path").isNull() & F.col("after_path").isNull(), None).when(
        nearer, F.col("before_hashes")).otherwise(F.col("after_hashes"))
    near = [f"{name}_hashes" for name in steps]
    others = [F.when(F.coalesce(F.greatest(*(F.arrays_overlap(a, b) for b in near if b != a)), F.lit(False)), F.col(a)) for a in near]
    return dealt.where("guest = 0").select(
        "host", "path", "hashes", found.alias("partner_hashes"), F.array_compact(F.array(*others)).alias("other_hashes")
    ).where("partner_hashes is not null")


def _size(hashes: list[int]) -> int:
    return sum(h & LENGTH for h in hashes)


def _alike(a: list[int], b: list[int], shared: list[int]) -> bool:
    """Whether the lines of ``a`` that ``b`` has too make them near copies."""
    return 2 * _size(shared) >= min(_size(a), _size(b))


def repeated(article: list[int], others: list[list[int]]) -> set[int]:
    """Positions of the lines that two of ``others`` have, neither being a near copy of ``article`` or of the other."""
    unlike: list[tuple[list[int], set[int]]] = []
    for other in others:
        shared = [] if set(article).isdisjoint(other) else common(article, other)
        if shared and not _alike(article, other, [article[n] for n in shared]):
            unlike.append((other, set(shared)))
    gone: set[int] = set()
    for k, (a, in_a) in enumerate(unlike):
        for b, in_b in unlike[:k]:
            if in_a & in_b and not _alike(a, b, [a[n] for n in common(a, b)]):
                gone |= in_a & in_b
    return gone


def _proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each path is compared with: its partner's lines outside articles, and the article lines proposed."""
    for batch in batches:
        partner, proposed = [], []
        for hashes, other, others in rows_of([batch], "hashes", "partner_hashes", "other_hashes"):
            article = [h for h in hashes if h & ARTICLE]
            gone = repeated(article, [[h for h in o if h & ARTICLE] for o in others])
            partner.append([h for h in other if not h & ARTICLE])
            proposed.append(sorted({article[n] for n in gone}))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("path"), pa.array(partner, longs), pa.array(proposed, longs)],
                                         ["host", "path", "partner", "proposed"])


#: Up to this many rows a side of a join is broadcast (some 100 bytes each).
BROADCAST_ROWS = 100_000
LEAST_PATHS = 3


def _small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def site_lines(paths: DataFrame, compared: DataFrame) -> DataFrame:
    """(host, site): article lines that were proposed on a host and that at least half of its paths have."""
    proposed = materialise(compared.select("host", F.explode("proposed").alias("line")).distinct(), "proposed")
    held = paths.select("host", F.explode(F.array_distinct(F.filter("hashes", lambda h: h.bitwiseAND(F.lit(ARTICLE)) != 0))).alias("line"))
    times = held.join(_small(proposed), ["host", "line"]).groupBy("host", "line").agg(F.count(F.lit(1)).alias("times"))
    hosts = paths.join(_small(materialise(proposed.select("host").distinct(), "hosts")), "host").groupBy("host").agg(F.count(F.lit(1)).alias("paths"))
    common_lines = times.join(hosts, "host").where((F.col("paths") >= LEAST_PATHS) & (2 * F.col("times") >= F.col("paths")))
    return materialise(common_lines.groupBy("host").agg(F.collect_list("line").alias("site")), "site-lines")


def _shared(hashes: list[int], partner: list[int], site: set[int]) -> set[int]:
    """Positions of the lines that differencing deletes."""
    undecided = [n for n, h in enumerate(hashes) if not h & ARTICLE]
    gone = {undecided[n] for n in common([hashes[n] for n in undecided], partner)}
    return gone | {n for n, h in enumerate(hashes) if h in site}


def _delete_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for lines, hashes, partner, site in rows_of([batch], "lines", "hashes", "partner", "site"):
            gone = _shared(hashes, partner or [], set(site or []))
            if len(gone) == len(lines):
                gone = set()
            texts.append("\n".join(text for n, text in enumerate(lines) if n not in gone))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages(page_id, url, html)``."""
    rows = _addressed(pages)
    hashed = rows.mapInArrow(_hashed, "page_id long, host string, path string, hashes array<long>")
    paths = hashed.groupBy("host", "path").agg(F.min_by("hashes", "page_id").alias("hashes"))
    paths = materialise(paths.withColumn("hashes", F.coalesce("hashes", F.array().cast("array<long>"))), "line-hashes")
    compared = materialise(partners(paths).mapInArrow(
        _proposed, "host string, path string, partner array<long>, proposed array<long>"), "compared")
    evidence = compared.drop("proposed").join(_small(site_lines(paths, compared)), "host", "left")
    parsed = rows.mapInArrow(_parsed, "page_id long, url string, host string, path string, lines array<string>, hashes array<long>")
    return parsed.join(evidence, ["host", "path"], "left").mapInArrow(
        _delete_shared, "page_id long, url string, text string, n_chars long")
