"""Main text of web pages: structure, and differencing with the page of the nearest URL.

A page becomes lines, one a block. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are recognised by element, role, class or id. Where <article> and <main> elements hold at least half of what is left of a page,
its lines are those inside; else they are lines like others.
Pages of a host that have the same lines are one page here. The distinct pages are put in order of host and URL path over the whole
cluster, and of the NEAR pages to either side the one of the same host whose path has the least edit distance is a page's partner.
The lines of both, main ones included, are aligned by a longest common subsequence.

A shared line is either the site's template or a passage that two texts share. The host's pairs decide: a line that at least half of them have
in common is the template's, however much of a page the template is. Pairs of near copies tell nothing and have no vote; these are pairs
whose shorter page has less than a tenth of its characters for itself. Inside <article> and <main>, which say of themselves that they are the
text, more is asked for: pairs vote that share less than half of the shorter page's characters, and at least LEAST_VOTES of them must have the line,
so that a passage shared by the few pages of a small host stays. Each page loses the template's lines that it shares with its partner.

No host is gathered anywhere: the order is by range, positions are counted by ranges, and what is shuffled are hashes of lines. Html is
parsed a second time at the end, and joined only with the list of pages that lose lines.

Defined results: null or empty html gives an empty text; a null or unparsable url has no partner; pages of a host alone are
parsed only; equal distances take the partner that comes first in order; repeated rows are answered alike; an end tag that HTML
lets out is supplied, another unclosed element ends with the page; an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

NEAR, LEAST_VOTES = 8, 4
BLOCK = 10_000  #: pages of one window of neighbours

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>?|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# HTML's elements by what they do to the text.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style textarea title xmp".split())
DROPPED = set("head nav footer aside form noscript template menu dialog button select iframe object svg canvas audio video header".split())
MAIN = {"article", "main"}
# Elements whose end tag may be left out, and the start tags that end them.
BLOCKS = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
IMPLIED = {
    "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription signup "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager masthead footer social share sharing related recommended "
    "comment comments disqus replies popup modal overlay notice notices banner".split()
)
WHOLE_NAMES = NAMES | set("header site-header page-header alert widget toolbar skip-link legal copyright side login search topbar".split())
#: Words that may stand beside one of NAMES in a compound name; with any other word the name tells of something else.
BESIDE = set(
    "list box block section widget container wrapper wrap area panel bar link links post posts article articles item items icon icons button buttons site page main top "
    "bottom left right side primary secondary inner outer header title form text body content slot unit inline row col column global local mobile desktop sticky fixed "
    "floating google user reader blog thread count toggle close message group".split()
)


def _named(word: str) -> bool:
    if word in WHOLE_NAMES:
        return True
    parts = [x for x in re.split(r"[-_]+", word) if x and not x.isdigit()]
    return any(x in NAMES for x in parts) and all(x in NAMES or x in BESIDE for x in parts)


def _boilerplate(attributes: str) -> bool:
    """Whether role, class, id or visibility mark an element as no part of the text."""
    if not attributes or attributes.isspace():
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape(value.strip("\"'")).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and any(map(_named, value.split())):
            return True
    return False


def _ends(open_tags: list[str], tag: str) -> int | None:
    """How many of the open tags stay when a start tag comes that ends the last block among them; None where it ends none."""
    for k in range(len(open_tags) - 1, -1, -1):
        if open_tags[k] not in INLINE:
            return k if tag in IMPLIED.get(open_tags[k], ()) else None
    return None


def lines_of(html: str | None) -> list[tuple[str, bool]]:
    """(text, inside article or main) of each block that isn't boilerplate by structure; only those inside where these hold half of the characters, else all, none marked."""
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    dropped: list[str] = []  # the open tags of a part that is left out, its own first
    inside, at = 0, 0
    html = html or ""

    def close():
        if held:
            if line := " ".join(unescape("".join(held)).split()):
                out.append((line, inside > 0))
            held.clear()

    while m := TOKEN.match(html, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            if not dropped and m[0][0] != "<" or m[0] == "<":
                held.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:  # an end tag
            if tag in dropped:
                del dropped[len(dropped) - 1 - dropped[::-1].index(tag) :]
                continue
            if dropped:
                if tag in INLINE or not all(x in IMPLIED or x in INLINE for x in dropped):
                    continue
                dropped.clear()  # the end of what is around it
            if tag in INLINE:
                continue
            close()
            if tag in MAIN and inside:
                inside -= 1
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            at = end.start() if end else len(html)
            if end:
                at = (html.find(">", at) + 1) or len(html)
            continue
        if dropped:
            while (stay := _ends(dropped, tag)) is not None:
                del dropped[stay:]
            if dropped and dropped[0] == "form" and tag in MAIN:  # a form around the whole page
                dropped.clear()
            if dropped:
                if tag not in VOID and not m[3].rstrip().endswith("/"):
                    dropped.append(tag)
                continue
        if tag not in INLINE:
            close() if tag != "br" else held.append(" ")
        if tag in VOID:
            continue
        comment = tag in MAIN and re.search(r"\b(comments?|teaser|related|promo)\b", m[3], re.I)
        drop = tag in DROPPED and not (tag == "header" and inside) or comment
        if drop or (tag not in MAIN and tag not in ("html", "body") and _boilerplate(m[3])):
            if tag == "head":
                end = re.compile(r"</head\s*>|<body", re.I).search(html, at)
                at = end.start() if end else at
                continue
            if tag in INLINE:
                held.append(" ")
            dropped.append(tag)
        elif tag in MAIN:
            inside += 1
    close()
    within = [x for x in out if x[1]]
    if within and 2 * _size(within) >= _size(out):
        return within
    return [(x, False) for x, _ in out]


def _size(lines: list[tuple[str, bool]]) -> int:
    return sum(len(x) for x, _ in lines)


def _rows(a: list[int], b: list[int]):
    """After each of a's lines, a number whose unset bits mark where the common subsequence with b grows (bit-parallel)."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        both = row & at.get(x, 0)
        row = (row + both | row & ~both) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each beginning of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def shared(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence with b.

    Common ends are taken first; what is left goes through bit-parallel rows, which are kept up to 4 MB; beyond that a is halved and b is cut
    where the halves' lengths sum up to most, so memory stays linear.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = {*range(head), *range(len(a) - tail, len(a))}
    known = set(b[head : len(b) - tail])
    places = [i for i in range(head, len(a) - tail) if a[i] in known]
    a2, b2 = [a[i] for i in places], [x for x in b[head : len(b) - tail] if x in {a[i] for i in places}] if places else []
    if not a2:
        return out
    if len(a2) * len(b2) > 1 << 25 and len(a2) > 1:
        half = len(a2) // 2
        cut = int(np.argmax(_lengths(a2[:half], b2) + _lengths(a2[half:][::-1], b2[::-1])[::-1]))
        found = shared(a2[:half], b2[:cut]) | {half + i for i in shared(a2[half:], b2[cut:])}
    else:
        rows, found = list(_rows(a2, b2)), set()
        i, j = len(a2), len(b2)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                found.add(i)
    return out | {places[i] for i in found}


def _keyed(pages: DataFrame) -> DataFrame:
    """Add host, path, and k1 and k2, 96 bits that tell html apart."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"(/|\.html?)$", "")
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": path, "k1": F.xxhash64("html"), "k2": F.hash("html")})


def line_hashes(keyed: DataFrame) -> DataFrame:
    """(host, path, k1, k2, c1, c2, hashes, sizes, main) of every page that has a host: hashes and characters of its lines, c1 and c2 of all of them, and whether they are main."""
    small_batches(keyed.sparkSession)
    keep = ["host", "path", "k1", "k2"]

    def run(batches):
        from xxhash import xxh3_64_intdigest as digest
        from xxhash import xxh3_128_intdigest as wide

        for batch in batches:
            found = [lines_of(h) for h in batch.column("html").to_pylist()]
            hashes = [[digest(x) - (1 << 63) for x, _ in page] for page in found]
            all_of = [wide(np.array([*h, any(m for _, m in page)], np.int64).tobytes()) for h, page in zip(hashes, found, strict=True)]
            made = [
                pa.array([(x >> 64) - (1 << 63) for x in all_of], pa.int64()),
                pa.array([(x & (1 << 64) - 1) - (1 << 63) for x in all_of], pa.int64()),
                pa.array(hashes, pa.list_(pa.int64())),
                pa.array([[len(x) for x, _ in page] for page in found], pa.list_(pa.int32())),
                pa.array([any(m for _, m in page) for page in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, "c1", "c2", "hashes", "sizes", "main"])

    return keyed.where("host <> ''").select(*keep, "html").mapInArrow(run, "host string, path string, k1 long, k2 int, c1 long, c2 long, hashes array<long>, sizes array<int>, main boolean")


def partners(distinct: DataFrame, near: int = NEAR, block: int = BLOCK) -> DataFrame:
    """(host, c1, c2, p1, p2): of the near pages to either side in order, the one of the host with the nearest path."""
    order = ["host", "path", "c1", "c2"]
    ranged = distinct.select(*order).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "page-order")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    placed = ranged.withColumn("inside", inside).join(F.broadcast(starts), "part").select(*order, (F.col("start") + F.col("inside") - 1).alias("at"))
    # Windows over blocks of the order; rows near a border are in both blocks.
    blocks = F.array_distinct(F.array(*(F.floor((F.col("at") + d) / block) for d in (-near, 0, near))))
    spread = placed.withColumn("own", F.floor(F.col("at") / block)).withColumn("block", F.explode(blocks))
    beside = Window.partitionBy("block").orderBy("at").rowsBetween(-near, near)
    listed = spread.withColumn("beside", F.collect_list(F.struct("at", "host", "path", "c1", "c2")).over(beside)).where("own = block")
    others = F.filter("beside", lambda x: (x["host"] == F.col("host")) & (x["at"] != F.col("at")))
    ranked = F.transform(others, lambda x: F.struct(F.levenshtein(F.col("path"), x["path"]).alias("d"), x["at"].alias("at"), x["c1"].alias("p1"), x["c2"].alias("p2")))
    return listed.select("host", "c1", "c2", F.array_min(ranked).alias("best")).where("best is not null").select("host", "c1", "c2", "best.p1", "best.p2")


def compare(distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """(host, c1, c2, main, independent, lines): of each page with a partner, the shared lines (place, hash), and whether the pair may vote."""
    other = distinct.select("host", F.col("c1").alias("p1"), F.col("c2").alias("p2"), F.col("hashes").alias("other"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("size"))
    joined = distinct.join(pairs, ["host", "c1", "c2"]).join(other, ["host", "p1", "p2"]).select("host", "c1", "c2", "main", "hashes", "sizes", "other", "size")

    def run(batches):
        kind = pa.list_(pa.struct([("place", pa.int32()), ("hash", pa.int64())]))
        for batch in batches:
            votes, lines = [], []
            for main, mine, sizes, other, size in zip(*(batch.column(c).to_pylist() for c in ("main", "hashes", "sizes", "other", "size")), strict=True):
                common = sorted(shared(mine, other))
                votes.append(independent(sum(sizes[i] for i in common), min(sum(sizes), size), main))
                lines.append([{"place": i, "hash": mine[i]} for i in common])
            columns = [*(batch.column(c) for c in ("host", "c1", "c2", "main")), pa.array(votes, pa.bool_()), pa.array(lines, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "c1", "c2", "main", "independent", "lines"])

    return joined.mapInArrow(run, "host string, c1 long, c2 long, main boolean, independent boolean, lines array<struct<place:int,hash:long>>")


def independent(common: int, shorter: int, main: bool) -> bool:
    """Whether a pair votes: characters of the shared lines and of the shorter page."""
    return 2 * common < shorter if main else 10 * common <= 9 * shorter


def template_lines(compared: DataFrame, least: int = LEAST_VOTES) -> DataFrame:
    """(host, hash, main): lines that at least half of a host's voting pairs have in common; main and other pages vote for themselves."""
    free = compared.where("independent")
    pairs = free.groupBy("host", "main").agg(F.count("*").alias("pairs"))
    each = free.select("host", "main", "c1", "c2", F.explode("lines").alias("x")).select("host", "main", "x.hash", "c1", "c2").distinct()
    votes = each.groupBy("host", "main", "hash").agg(F.count("*").alias("votes"))
    enough = (F.col("votes") * 2 >= F.col("pairs")) & (~F.col("main") | (F.col("votes") >= least))
    return votes.join(pairs, ["host", "main"]).where(enough).select("host", "hash", "main")


def deletions(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((host, k1, k2, places): the lines that each page loses, for pages that lose any; what compare() found)."""
    lines = materialize(line_hashes(keyed), "page-lines")
    distinct = lines.where("size(hashes) > 0").groupBy("host", "c1", "c2").agg(F.min("path").alias("path"), *(F.first(c).alias(c) for c in ("hashes", "sizes", "main")))
    distinct = materialize(distinct, "distinct-pages")
    compared = materialize(compare(distinct, partners(distinct)), "shared-lines")
    shared_lines = compared.select("host", "c1", "c2", "main", F.explode("lines").alias("x")).select("host", "c1", "c2", "main", "x.*")
    gone = shared_lines.join(template_lines(compared), ["host", "hash", "main"]).groupBy("host", "c1", "c2").agg(F.collect_set("place").alias("places"))
    pages = lines.select("host", "k1", "k2", "c1", "c2").join(gone, ["host", "c1", "c2"])
    return materialize(pages.select("host", "k1", "k2", "places").dropDuplicates(["host", "k1", "k2"]), "deletions"), compared


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_template) of every page; n_template: lines that it lost by comparison with its partner."""
    keyed = _keyed(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")))
    gone, _ = deletions(keyed)
    joined = keyed.join(gone, ["host", "k1", "k2"], "left").select("page_id", "url", "html", "places")

    def run(batches):
        for batch in batches:
            texts, lost = [], []
            for page, places in zip(batch.column("html").to_pylist(), batch.column("places").to_pylist(), strict=True):
                out = set(places or ())
                texts.append(" ".join(x for i, (x, _) in enumerate(lines_of(page)) if i not in out))
                lost.append(len(out))
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(lost, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *made], names=["page_id", "url", "text", "n_chars", "n_template"])

    kind = keyed.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_template long").withColumnsRenamed({"page_id": page_id, "url": url})


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
