"""Main text of web pages: markup tells articles from chrome, a suffix array over each host finds boilerplate in both.

Markup first, by one linear scan: scripts, styles, menus, headers, footers, sidebars, forms, adverts, notices and comments
are chrome. Where a page marks its article (article, main or role=main), the article's blocks are its candidates; in
other pages, all visible text is. Then, on every page:

1. The tokens of a page's candidate blocks are concatenated to one stream, those of its other text to another. The
   suffixes of all streams of a host are ordered by their first RUN tokens, by prefix doubling of 64-bit ranks (1, 2, 4,
   8 tokens), so that suffixes with RUN tokens in common, as neighbours in a suffix array whose LCP is RUN or more, have
   one rank. Longer repeats are unions of such runs, so this depth finds every token of every repeat of RUN or more.
2. Text outside of marked articles tells what a host repeats: for each (host, rank) there, the least and greatest page and
   the number of pages. These are aggregates with partial sums in each task, so neither a hot host nor a hot run meets in
   one task.
3. A run is boilerplate if at least half of the host's pages, and SHOWN of them, have it outside of a marked article, another page
   than its own among them: so a notice that a template puts into articles goes, and so does unnamed chrome of pages that mark no
   article, while what articles quote from each other, or a teaser elsewhere quotes from one, stays. Suffixes that can't be
   boilerplate are left out before the shuffle, by a bitmap of fixed size.
4. Boilerplate tokens go, where a block has RUN or more of them in a row or no others; what is left of each block, its
   unique runs, stays.

A tag that the end of the page cuts off, or an unclosed comment, script or quoted value, goes on to the end of the page,
as in browsers. The scan reads each character a bounded number of times, whatever the markup, so a page of many MB takes
time in proportion.

Defined results: a null or empty page has an empty text; unclosed elements end with the page; repeated rows are pages of
their own, but count as one page (by page_id and url) for what is repeated; input columns besides page_id, url and html are
not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import combine, held_bits, materialise, released, span_hashes, table, text_slices, words

#: Tokens of the shortest repeat that counts as boilerplate; a power of two.
RUN = 8
#: Pages of a host, and at least half of them, that have a run outside of articles if it is boilerplate.
SHOWN = 3
#: Rows that a host's number of pages is spread over, so that a hot host's runs meet it in as many tasks.
SPREAD = 64

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
_PLAIN = re.compile(r"[^>=]*")
_WHITE = re.compile(r"\s*")
_BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_CHROME = frozenset("nav header footer aside form menu dialog button search".split())
_NESTING = frozenset("article main section div span p ul ol li table figure blockquote details".split()) | _CHROME
#: Elements whose content is no text of the page; those of the first kind hold no markup of their own.
_RAW = frozenset("script style title textarea iframe".split())
_SKIPPED = _RAW | frozenset("noscript template svg math object select".split())
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _SKIPPED}
_MARKS = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Words of class and id names that mark chrome, words that may stand beside them, and chrome roles: fixed values.
_CHROME_WORDS = frozenset("ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments commentlist replies respond disqus share sharing social related recommended pagination pager toolbar".split())
_BESIDE = frozenset("site page main global top bottom left right primary secondary box wrap wrapper container block section list area unit slot bar inner outer group links buttons posts articles stories form panel widget the".split())
_CHROME_ROLES = frozenset("banner complementary contentinfo dialog navigation search".split())
_WORD_PARTS = re.compile(r"[-_0-9]+")
_SPACE = re.compile(r"\s+")


def _named_chrome(name: str) -> bool:
    """Whether a class or id says chrome: all of its parts are chrome words or words beside them, one at least of the former."""
    parts = [p for p in _WORD_PARTS.split(name.lower()) if p]
    return any(p in _CHROME_WORDS for p in parts) and all(p in _CHROME_WORDS or p in _BESIDE for p in parts)


def _tag_end(source: str, at: int) -> int:
    """Where the > of the tag is whose name ends at; -1 if there is none. Quoted values are passed over."""
    while True:
        at = _PLAIN.match(source, at).end()
        if at == len(source):
            return -1
        if source[at] == ">":
            return at
        at = _WHITE.match(source, at + 1).end()
        if at < len(source) and source[at] in "\"'":
            at = source.find(source[at], at + 1) + 1
            if not at:
                return -1


class Page:
    """blocks inside the article, blocks outside it that aren't chrome, chrome blocks, and whether an article is marked."""

    def __init__(self, source: str):
        self.article: list[str] = []
        self.loose: list[str] = []
        self.chrome: list[str] = []
        self.marked = False
        self._stack: list[tuple[str, int]] = []  # open elements, each with 1 for an article, 2 for chrome, else 0
        self._open: dict[str, int] = {}
        self._inside = self._hidden = 0
        self._parts: list[str] = []
        self._scan(source)
        self._flush()

    def _flush(self) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(self._parts))).strip()
        self._parts.clear()
        if text:
            (self.chrome if self._hidden else self.article if self._inside else self.loose).append(text)

    def _scan(self, source: str) -> None:
        at, unclosed = 0, set()
        while True:
            lt = source.find("<", at)
            if lt < 0:
                self._parts.append(source[at:])
                return
            self._parts.append(source[at:lt])
            if source.startswith("<!--", lt):
                at = source.find("-->", lt + 4) + 3
                if at < 3:
                    return
                continue
            if source.startswith("<![CDATA[", lt):
                at = source.find("]]>", lt + 9) + 3
                if at < 3:
                    return
                continue
            closing = source.startswith("</", lt)
            m = _NAME.match(source, lt + 1 + closing)
            if not m:
                if source[lt + 1 : lt + 2] in ("!", "?", "/") and lt + 1 < len(source):
                    at = source.find(">", lt) + 1
                    if not at:
                        return
                else:
                    self._parts.append("<")
                    at = lt + 1
                continue
            gt = _tag_end(source, m.end())
            if gt < 0:
                return
            name, at = m.group().lower(), gt + 1
            if closing:
                self._close(name)
                continue
            rest = source[m.end() : gt]
            if name in _SKIPPED and not rest.endswith("/"):
                end = None if name in unclosed else _CLOSE[name].search(source, at)
                if end:
                    at = end.end()
                elif name in _RAW:
                    return
                else:
                    unclosed.add(name)
                continue
            self._start(name, rest)

    def _start(self, name: str, rest: str) -> None:
        if name == "br":
            self._parts.append(" ")
            return
        if name in _BLOCKS:
            self._flush()
        if name not in _NESTING or rest.rstrip().endswith("/") or (name in ("p", "span") and not rest):
            return
        kind = 2 if name in _CHROME else 1 if name in ("article", "main") else 0
        for attribute, *values in _MARKS.findall(rest) if rest and kind != 1 else ():
            for value in next(filter(None, values), "").split():
                if attribute.lower() == "role":
                    kind = 1 if value.lower() == "main" else 2 if value.lower() in _CHROME_ROLES else kind
                elif kind == 0 and _named_chrome(value):
                    kind = 2
        if kind == 2 and name not in _BLOCKS:
            self._flush()
        if kind == 1 and not self._hidden:
            self.marked = True
        self._stack.append((name, kind))
        self._open[name] = self._open.get(name, 0) + 1
        self._inside += kind == 1
        self._hidden += kind == 2

    def _close(self, name: str) -> None:
        if name in _BLOCKS:
            self._flush()
        if not self._open.get(name):
            return
        self._flush()
        while True:
            last, kind = self._stack.pop()
            self._open[last] -= 1
            self._inside -= kind == 1
            self._hidden -= kind == 2
            if last == name:
                return


def suffix_ranks(tokens: np.ndarray) -> np.ndarray:
    """The rank of each suffix by its first RUN tokens (for those that have so many), by prefix doubling."""
    ranks, step = tokens, 1
    while step < RUN and len(ranks) > step:
        ranks, step = combine(ranks[:-step], ranks[step:]), 2 * step
    return ranks if step == RUN and len(tokens) >= RUN else tokens[:0]


def stream_ranks(blocks: list[str]) -> np.ndarray:
    """suffix_ranks() of the concatenated tokens of blocks."""
    data = np.frombuffer(" ".join(blocks).encode(), np.uint8)
    w = words(data, np.array([0, len(data)]))
    return suffix_ranks(span_hashes(data, w.start, w.end)).view(np.int64)


_HOST = re.compile(r".*?://([^/?#]*)", re.S)
_PAGE = [("task", pa.int32()), ("row", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("marked", pa.bool_()), ("blocks", pa.list_(pa.string())), ("outside", pa.list_(pa.int64()))]


def parse(pages: DataFrame) -> DataFrame:
    """One row a page: its candidate blocks, and the ranks of the suffixes of its text outside of a marked article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, _, _ in text_slices(batch, "html"):
                out = []
                for page_id, url, source in zip(*(rows.column(c).to_pylist() for c in range(3)), strict=True):
                    page = Page(source)
                    own = page.article if page.marked else page.loose
                    outside = [stream_ranks(page.chrome), stream_ranks(page.loose)]
                    host = _HOST.match(url or "")
                    out.append((task, row, page_id, url, host.group(1).lower() if host else "", page.marked, own, np.unique(np.concatenate(outside))))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), _PAGE, strict=True)], [n for n, _ in _PAGE])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(released(run), "task int, row long, page_id long, url string, host string, marked boolean, blocks array<string>, outside array<long>")


def candidates(parsed: DataFrame, known: Callable) -> DataFrame:
    """site, page, task, row, place, rank: the suffixes of candidate streams that may be known outside of articles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            site = batch.column(0).to_numpy(zero_copy_only=False)
            at, place, rank = [], [], []
            for k, blocks in enumerate(batch.column(4).to_pylist()):
                ranks = stream_ranks(blocks)
                hit = np.flatnonzero(known(ranks, np.full(len(ranks), site[k])))
                at.append(np.full(len(hit), k))
                place.append(hit)
                rank.append(ranks[hit])
            who = pa.array(np.concatenate(at)) if at else pa.array([], pa.int64())
            made = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (place, rank)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(who) for c in range(4)), *(pa.array(x) for x in made)], ["site", "page", "task", "row", "place", "rank"])

    return parsed.select("site", "page", "task", "row", "blocks").mapInArrow(released(run), "site long, page long, task int, row long, place long, rank long")


def unique_runs(block: str, covered: np.ndarray) -> str:
    """block without its covered tokens, where RUN or more are in a row, or all are; tokens are parted by blanks, the
    only white space that blocks have. Fewer are the edge of a run in the block beside."""
    if covered.all():
        return ""
    edges = np.flatnonzero(np.diff(covered, prepend=False, append=False)).reshape(-1, 2)
    tokens, at, out = block.split(" "), 0, []
    for lo, hi in edges[edges[:, 1] - edges[:, 0] >= RUN].tolist():
        out += tokens[at:lo]
        at = hi
    return " ".join(out + tokens[at:])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and boilerplate_tokens for every row of pages, which has page_id, url and html.

    Only pages that hold boilerplate (and the false positives of a bitmap of fixed size) go through a shuffle.
    """
    parsed = materialise(parse(pages)).withColumns({"site": F.xxhash64("host"), "page": F.xxhash64("page_id", "url")})
    shown = parsed.select("site", "page", F.explode("outside").alias("rank")).groupBy("site", "rank").agg(F.min("page").alias("a"), F.max("page").alias("b"), F.count_distinct("page").alias("n"))
    hosts = parsed.groupBy("site").agg(F.count_distinct("page").alias("pages")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    shown = shown.where(F.col("n") >= SHOWN).withColumn("part", F.pmod("rank", F.lit(SPREAD)).cast("int"))
    often = materialise(shown.join(hosts, ["site", "part"]).where(2 * F.col("n") >= F.col("pages")).select("site", "rank", "a", "b"))
    made = candidates(parsed, held_bits(often, "rank", "site"))
    found = made.join(often, ["site", "rank"]).where("a <> page or b <> page").select("task", "row", "place")
    covered = materialise(found.groupBy("task", "row").agg(F.collect_set("place").alias("covered")))
    hit = held_bits(covered, "row", "task")

    @F.pandas_udf("boolean")
    def touched(row: pd.Series, task: pd.Series) -> pd.Series:
        return pd.Series(hit(row.to_numpy(), task.to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for blocks, spots in zip(*(batch.column(c).to_pylist() for c in (2, 3)), strict=True):
                mask = np.zeros(sum(len(b.split(" ")) for b in blocks), bool)
                for k in range(RUN if spots else 0):
                    mask[np.array(spots) + k] = True
                counts.append(int(mask.sum()))
                left, at = [], 0
                for block in blocks if spots else ():
                    n = len(block.split(" "))
                    left.append(unique_runs(block, mask[at : at + n]) if mask[at : at + n].any() else block)
                    at += n
                texts.append("\n".join(b for b in left if b) if spots else "\n".join(blocks))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())], ["page_id", "url", "text", "n_chars", "boilerplate_tokens"])

    rows = parsed.select("task", "row", "page_id", "url", "blocks", touched("row", F.col("task").cast("long")).alias("touched"))
    cut = rows.where("touched").join(covered, ["task", "row"], "left").select("page_id", "url", "blocks", "covered").mapInArrow(run, "page_id long, url string, text string, n_chars long, boilerplate_tokens long")
    whole = rows.where("not touched").select("page_id", "url", F.array_join("blocks", "\n").alias("text"))
    return whole.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), F.lit(0).cast("long").alias("boilerplate_tokens")).unionAll(cut)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
