"""Main text of web pages by nearest-URL page differencing.

Every page is read into text lines (one per block element), each with what the markup says of it:
boilerplate (navigation, adverts, forms, comments ...), main (inside an article or main element) or
open. Pages of one host stand in the order of their URL paths, and each is paired with its nearest
neighbours. All lines of both, those of articles too, are aligned by their longest common subsequence,
and a line that a page shares with more than half of up to PARTNERS neighbours is template. A neighbour
with NEAR of the page's text (of what the markup does not call boilerplate, where there is any) in common
is a copy of it, not another page of its template, and is passed over. What is left is then checked
against the markup, as differencing alone would delete what two articles have in common (quotes) and
keep what is new on each page (adverts): template lines that are main come back, and of the other lines
those that the markup calls boilerplate go too, and where a page has main lines, those outside of them.

Where a page stands depends on the table alone, not on its partitions: pages with equal outlines on
a host count once, all others are numbered through, and a host of n is dealt into runs of about RUN
neighbours, within which pages are paired. Only outlines (a hash and a size for each line) are shuffled for that, so a host of any size is spread over tasks.

Cases: a null or empty html gives an empty text; a page without another outline in its run keeps its
open lines; a null url belongs to the host ""; an unclosed nav, header, form or menu ends where an
article begins; an article inside other boilerplate (comments, asides), or marked so itself, is
boilerplate; repeated rows and repeated page_ids are extracted each; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heron.plans.session import cut, discard, table

BOILERPLATE, MAIN, OPEN = 0, 1, 2
RUN, PARTNERS, NEAR = 32, 4, 0.9
#: HTML element names by their role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SPACED = frozenset("br td th option img input wbr".split()) - {"wbr", "img"}
DROPPED = frozenset("head title nav footer aside form menu dialog button select option noscript template iframe object canvas svg audio video".split())
#: Boilerplate that pages leave unclosed; an article ends it.
UNFIRM = frozenset("head title nav header form menu".split())
CLOSES_ITSELF = frozenset("p li dt dd option tr td th".split())
#: Words of class, id and role that mark boilerplate, those that do so on an article, and words that may stand beside them in a compound; fixed values.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "cookie cookies consent notice notices alert popup modal overlay comment comments commentlist respond discussion discussions disqus replies reply share sharing social related recommended "
    "newsletter subscribe subscription signup login footer masthead topbar toolbar pagination pager widget complementary contentinfo search side-bar".split()
)
ON_ARTICLE = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies disqus related recommended".split())
BESIDE = frozenset(
    "list item items area section box block wrapper wrap container inner outer left right top bottom bar button buttons link links post posts article entry story user reader "
    "thread form body author text content meta site page main primary secondary global left-rail rail panel group row col header title slot unit".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|xmp|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*[^>]*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def _marks(token: str, marks: frozenset[str], in_main: bool) -> bool:
    """Whether a class, id or role is a word that marks boilerplate, or is made of such words and those beside them."""
    if token.lower() in marks or (token.lower() == "header" and not in_main):
        return True
    parts = [x.lower() for x in _PARTS.findall(token)]
    if parts == ["site", "header"] or parts == ["page", "header"]:
        return not in_main
    return any(x in marks for x in parts) and all(x in marks or x in BESIDE or x.isdigit() for x in parts)


def _role(name: str, attributes: str, in_main: bool) -> tuple[int | None, bool]:
    """What an opening tag says of its content (None if nothing), and whether that holds for articles inside too."""
    found = MAIN if name in ("article", "main") else BOILERPLATE if name in DROPPED or (name == "header" and not in_main) else None
    firm = name not in UNFIRM
    if not attributes or name in ("body", "html"):
        return found, firm
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return BOILERPLATE, True
        if key == "role" and value.lower() == "main":
            found = MAIN
        elif key in ("class", "id", "role") and name != "main":
            if any(_marks(t, ON_ARTICLE if name == "article" else MARKS, in_main) for t in value.split()):
                return BOILERPLATE, True
    return found, firm


def lines(html: str | None) -> list[tuple[str, int]]:
    """The page's non-empty text lines, in order, each with its role."""
    html = html or ""
    out: list[tuple[str, int]] = []
    # Open elements that matter: (name, role, whether it holds for articles inside, whether a main element is around).
    stack: list[tuple[str, int, bool, bool]] = []
    where: dict[str, list[int]] = {}
    text: list[str] = []

    def flush() -> None:
        line = " ".join(unescape("".join(text)).split())
        text.clear()
        if line:
            out.append((line, stack[-1][1] if stack else OPEN))

    def close(depth: int) -> None:
        while len(stack) > depth:
            where[stack.pop()[0]].pop()

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        name, block = m[3].lower(), m[3].lower() in BLOCKS
        same = where.get(name)
        if m[2]:
            if block:
                flush()
            if same:
                depth = same[-1]
                inside = max((where[x][-1] for x in ("article", "main") if where.get(x)), default=-1)
                # A closing tag inside an article closes nothing around it.
                if name in ("article", "main", "body", "html") or inside <= depth:
                    if stack[depth][1] != stack[-1][1] or stack[depth][1] != (stack[depth - 1][1] if depth else OPEN):
                        flush()
                    close(depth)
            continue
        if name in SPACED:
            text.append(" ")
        if name in VOID:
            if name == "hr":
                flush()
            continue
        above = stack[-1] if stack else ("", OPEN, False, False)
        role, firm = _role(name, m[4], above[3]) if block or m[4] or name in DROPPED else (None, False)
        if not block and role is None and not same:
            # Inline, and no closing tag of its kind is waited for: only its text counts.
            continue
        if block or role is not None:
            flush()
        if name in CLOSES_ITSELF and stack and stack[-1][0] == name:
            close(len(stack) - 1)
            above = stack[-1] if stack else ("", OPEN, False, False)
        if role == MAIN and above[1] == BOILERPLATE and not above[2] and not above[3]:
            close(0)
            above = ("", OPEN, False, False)
        if above[1] == BOILERPLATE or role is None:
            role, firm = above[1], above[2] or (firm and above[1] == BOILERPLATE)
        if block or not m[4].endswith("/"):
            where.setdefault(name, []).append(len(stack))
            stack.append((name, role, role == BOILERPLATE and firm, above[3] or role == MAIN))
    if at < len(html):
        text.append(html[at:])
    flush()
    return out


def shared(a: list, b: list) -> set[int]:
    """Positions in a of one longest common subsequence of a and b; a bit-parallel exact alignment that holds one state in STEP."""
    first, last = 0, 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    out = set(range(first)) | set(range(len(a) - last, len(a)))
    both = set(a[first : len(a) - last]) & set(b[first : len(b) - last])
    at = [i for i in range(first, len(a) - last) if a[i] in both]
    b = [x for x in b[first : len(b) - last] if x in both]
    if not at:
        return out
    places: dict = {}
    for i, k in enumerate(at):
        places[a[k]] = places.get(a[k], 0) | 1 << i
    full = (1 << len(at)) - 1

    def follow(v: int, some: list) -> list[int]:
        rows = [v]
        for x in some:
            u = v & places[x]
            v = ((v + u) | (v - u)) & full
            rows.append(v)
        return rows

    step = max(16, int(len(b) ** 0.5))
    kept = [full]
    for low in range(0, len(b), step):
        kept.append(follow(kept[-1], b[low : low + step])[-1])
    i, j, rows, low = len(at), len(b), [], len(b)
    while i and j:
        if j <= low:
            low = (j - 1) // step * step
            rows = follow(kept[low // step], b[low : low + step])
        if rows[j - low] >> (i - 1) & 1:
            i -= 1
        elif rows[j - 1 - low] >> (i - 1) & 1:
            i, j = i - 1, j - 1
            out.add(at[i])
        else:
            j -= 1
    return out


def outline(page: list[tuple[str, int]]) -> tuple[list[int], list[int]]:
    """A hash of each line, and its length, negative where the markup calls it boilerplate."""
    return [int.from_bytes(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for x, _ in page], [-len(x) if role == BOILERPLATE else len(x) for x, role in page]


def deleted(pages: list[tuple[list[int], list[int]]]) -> list[list[int]]:
    """For each outline of a run, the places of the lines that it shares with most of its nearest neighbours that are no copies of it."""
    out = []
    for i, (keys, sizes) in enumerate(pages):
        weight = [max(0, n) for n in sizes] if any(n > 0 for n in sizes) else [-n for n in sizes]
        votes, partners = [0] * len(keys), 0
        for j in sorted(range(len(pages)), key=lambda j, i=i: (abs(j - i), j)):
            if j == i or partners == PARTNERS or not keys:
                continue
            same = shared(keys, pages[j][0])
            if sum(weight[x] for x in same) < NEAR * sum(weight):
                partners += 1
                for x in same:
                    votes[x] += 1
        out.append([x for x, n in enumerate(votes) if 2 * n > partners])
    return out


def main_text(page: list[tuple[str, int]], gone: list[int]) -> tuple[str, int, int]:
    """The page's text without the lines that differencing deletes, unless they are main, and without boilerplate, and how many lines went by either."""
    main, same, kept, by_sharing, by_markup = any(role == MAIN for _, role in page), set(gone), [], 0, 0
    for at, (x, role) in enumerate(page):
        if role == MAIN:
            kept.append(x)
        elif at in same:
            by_sharing += 1
        elif role == BOILERPLATE or main:
            by_markup += 1
        else:
            kept.append(x)
    return "\n".join(kept), by_sharing, by_markup


_PAGE = "page_id long, url string, host string, path string, outline binary, keys array<long>, sizes array<int>, lines array<string>, roles array<int>"
_TEXT = "page_id long, url string, text string, n_chars long, n_lines long, n_shared long, n_marked long"


def _batch(rows: list[tuple], schema: str):
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _pages(batches):
    for b in batches:
        rows = []
        for page_id, url, host, path, html in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            page = lines(html)
            keys, sizes = outline(page)
            rows.append((page_id, url, host, path, blake2b(repr((keys, sizes)).encode(), digest_size=16).digest(), keys, sizes, [x for x, _ in page], [role for _, role in page]))
        yield _batch(rows, _PAGE)


def _numbered(batches):
    """Sorted outlines with their partition and their place among the host's in it."""
    part, host, k = TaskContext.get().partitionId(), None, 0
    for b in batches:
        ks = []
        for h in b.column(0).to_pylist():
            host, k = (h, k + 1) if h == host else (h, 0)
            ks.append(k)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(ks), pa.int32()), pa.array(ks, pa.int64())], [*b.schema.names, "part", "k"])


def _pairs(batches):
    def close(run, rows):
        return [(run[0], o, gone) for (o, _, _), gone in zip(rows, deleted([(k, s) for _, k, s in rows]), strict=True) if gone] if rows else []

    now, rows = None, []
    for b in batches:
        out = []
        for host, run, o, keys, sizes in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if (host, run) != now:
                out += close(now, rows)
                now, rows = (host, run), []
            rows.append((o, keys, sizes))
        yield _batch(out, "host string, outline binary, gone array<int>")
    yield _batch(close(now, rows), "host string, outline binary, gone array<int>")


def _extract(batches):
    for b in batches:
        rows = []
        for page_id, url, texts, roles, gone in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            text, by_sharing, by_markup = main_text(list(zip(texts, roles, strict=True)), gone or [])
            rows.append((page_id, url, text, len(text), len(texts), by_sharing, by_markup))
        yield _batch(rows, _TEXT)


def shared_lines(pages: DataFrame) -> DataFrame:
    """(host, outline, gone): the places of the lines that pages of _PAGE share with most of their neighbours; outlines without any are left out."""
    spark = pages.sparkSession
    # Equal outlines of a host are one, at its first place.
    first = F.min(F.struct(F.col("path"), F.isnull("page_id"), F.col("page_id"), F.col("keys"), F.col("sizes"))).alias("x")
    distinct = cut(pages.groupBy("host", "outline").agg(first).select("host", "outline", "x.path", "x.page_id", "x.keys", "x.sizes"), "outlines")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ("host", "path", "page_id", "outline")
    by_url = distinct.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("host", "outline", "keys", "sizes")
    numbered = cut(by_url.mapInArrow(_numbered, "host string, outline binary, keys array<long>, sizes array<int>, part int, k long"), "outlines")
    discard(distinct)
    # A host's places through all partitions, from how many it has in each; a window holds one row for each partition.
    counts = numbered.groupBy("host", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("host").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = cut(counts.select("host", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(W.partitionBy("host")).alias("all")), "hosts")
    place, runs = F.col("first") + F.col("k"), F.ceil(F.col("all") / RUN)
    dealt = numbered.join(firsts, ["host", "part"]).select("host", F.floor(place * runs / F.col("all")).alias("run"), "outline", "keys", "sizes", place.alias("place"))
    dealt = dealt.repartition(parts, "host", "run").sortWithinPartitions("host", "run", "place").drop("place")
    return cut(dealt.mapInArrow(_pairs, "host string, outline binary, gone array<int>"), "shared")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html), then its lines and how many of them went by differencing and by markup."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    address = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?[^/?#]*([^?#]*)", 1)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.lower(address).alias("host"), path.alias("path"), F.col("html").cast("string"))
    # Every page is parsed once; its lines are read again when it is known which of them go.
    parsed = cut(rows.mapInArrow(_pages, _PAGE), "pages")
    # Only outlines with shared lines are on the right, and its size is known to Spark: it is broadcast if small, and a hot outline's rows are split if not.
    found = parsed.join(shared_lines(parsed), ["host", "outline"], "left")
    return found.select("page_id", "url", "lines", "roles", "gone").mapInArrow(_extract, _TEXT)


def op8_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: The tables' pages have one article each, without nested boilerplate, and six named references, whose semicolon may be missing.
ORACLE = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS h FROM pages
), b AS (
  SELECT page_id, url, regexp_split_to_array(regexp_replace(regexp_replace(h, '<br>', ' ', 'g'), '</?[bi]>', '', 'g'), '</?(?:p|h1)>') AS blocks FROM a
), c AS (
  SELECT page_id, url, [trim(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#(?:x27|39);?', '''', 'g'), '&amp;?', '&', 'g'),
    '[\s\x0B\x{00A0}]+', ' ', 'g')) for x in blocks] AS blocks FROM b
), d AS (
  SELECT page_id, url, array_to_string([x for x in blocks if x <> ''], chr(10)) AS text FROM c
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""
