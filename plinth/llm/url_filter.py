"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

Everything is DataFrame expressions. A listing has the columns key (canonical host followed by a path, like
``example.com/en/``), verdict and rank (a lower rank goes first; within a rank the longest key wins). An entry
fits its host and all subdomains of it, for paths that start with its path.

For each distinct url, the lookup keys are (host or parent domain) x (prefixes of the path, of lengths that the
listing has). Keys pass the filter of the listing, and only possible hits reach the join on the key itself,
which removes the filter's false positives. The filter is a table of 256-bit blocks keyed by block number, so
it is broadcast only while its number of blocks is below a bound, and joined by a shuffle beyond.

Defined results: a null url, or one without ``://``, has empty host and path and fits nothing. Repeated rows each
get their own row. Of listed keys of one rank and length that fit one url (``a.b.c/`` and ``b.c/xy``), the greater in byte order
wins; of one key's entries, the least rank, then the least verdict. Input columns are kept, but those of the names that are
added. A very long url has one key for each parent domain and listed length. An empty listing fits nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import fresh_name

#: Keys per 256-bit block: 16 bits a key, with 4 of them set.
KEYS_PER_BLOCK = 16
#: Blocks of 40 bytes that may be broadcast: about 2.6 MB.
BROADCAST_BLOCKS = 65_536
WORDS = 4

#: The rules for sections of hosts, as key and verdict: fixed values.
SECTION_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Hosts listed whole, with all their subdomains: the default listing of unwanted sites.
LISTED_SITES = ("spam-farm.example.org/", "spam-farm.example.com/", "spam-farm.example.net/", "cheap-pills.example.net/", "cheap-pills.example.com/", "cheap-pills.example.org/")


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark or hash, with A-Z lower-cased; empty without ://."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listing(spark: SparkSession, entries: list[tuple[str, str, int]]) -> DataFrame:
    """A listing of (key, verdict, rank) from values; large ones are read from a table instead."""
    return spark.createDataFrame(entries, "key string, verdict string, rank int")


def default_listing(spark: SparkSession) -> DataFrame:
    return listing(spark, [(k, v, 0) for k, v in SECTION_RULES] + [(k, "block", 1) for k in LISTED_SITES])


def _with_bits(df: DataFrame, blocks: int) -> DataFrame:
    """Adds a key's block, and m0..m3: one bit in each word of the block, from 6 bits of a second hash each."""
    masks = {f"m{i}": F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h2, {6 * i}) & 63 as int))") for i in range(WORDS)}
    return df.withColumns({"h2": F.xxhash64("key", F.lit(1)), "block": F.pmod(F.xxhash64("key"), F.lit(blocks))}).withColumns(masks).drop("h2")


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter's blocks: block, w0..w3."""
    return _with_bits(listed.select("key").where("key is not null"), blocks).groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def lookup_keys(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """url, key: one row for each key that could be listed for the url."""
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = [F.when(F.length("path") >= n, F.substring(F.col("path"), 1, n)) for n in lengths]
    return (
        urls.where("host <> ''")
        .withColumn("suffix", F.explode(hosts))
        .withColumn("prefix", F.explode(F.array(*fitting)))
        .where("prefix is not null")
        .select("url", F.concat("suffix", "prefix").alias("key"))
    )


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages' columns and host, path, rule (the fitting key of rank 0, or null), listed_key and verdict.

    Columns of those names in pages are replaced.
    """
    listed = listed.where("key is not null").groupBy("key").agg(F.min_by(F.struct("rank", "verdict"), F.struct("rank", "verdict")).alias("e")).select("key", "e.rank", "e.verdict")
    n, lengths = listed.agg(F.count("*"), F.array_sort(F.collect_set(F.length("key") - F.instr("key", "/") + 1))).first()
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "listed_key", "verdict")]
    pages = pages.select(*keep).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not n:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "listed_key": F.lit(None).cast("string"), "verdict": F.lit(default)})
    blocks = max(1, -(-n // KEYS_PER_BLOCK))
    filt = bloom(listed, blocks)
    filt = F.broadcast(filt) if blocks <= BROADCAST_BLOCKS else filt
    urls = pages.where(F.col(url).isNotNull()).select(F.col(url).alias("url"), "host", "path").distinct()
    keys = _with_bits(lookup_keys(urls, lengths), blocks)
    possible = keys.join(filt, "block").where(reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}") for i in range(WORDS)])).select("url", "key")
    hits = possible.join(listed, "key")
    best = hits.groupBy("url").agg(F.max_by("key", F.when(F.col("rank") == 0, F.struct(F.length("key"), "key"))).alias("rule"), F.max_by("verdict", F.when(F.col("rank") == 0, F.struct(F.length("key"), "key"))).alias("rule_verdict"), F.max_by("key", F.when(F.col("rank") > 0, F.struct(-F.col("rank"), F.length("key"), "key"))).alias("listed_key"), F.max_by("verdict", F.when(F.col("rank") > 0, F.struct(-F.col("rank"), F.length("key"), "key"))).alias("listed_verdict"))
    key, judged = fresh_name("url", pages.columns), fresh_name("verdict", pages.columns)
    best = best.select(F.col("url").alias(key), "rule", "listed_key", F.coalesce("rule_verdict", "listed_verdict").alias(judged))
    return pages.join(best, pages[url] == best[key], "left").withColumn("verdict", F.coalesce(judged, F.lit(default))).drop(key, judged)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, default_listing(spark)).select("page_id", "host", "path", "rule", "verdict")


def op6_sql() -> str:
    rules = ", ".join(f"('{k.split('/', 1)[0]}', '/{k.split('/', 1)[1]}', '{k}', '{v}', 0)" for k, v in SECTION_RULES)
    sites = ", ".join(f"('{k.split('/', 1)[0]}', '/', '{k}', 'block', 1)" for k in LISTED_SITES)
    return f"""
with listed(lh, lp, key, verdict, rank) as (values {rules}, {sites}),
p as (select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
u as (select distinct host, path from p),
m as (select u.host, u.path, l.key, l.verdict, l.rank, row_number() over (partition by u.host, u.path order by l.rank, length(l.key) desc) as rn
  from u join listed l on (u.host = l.lh or ends_with(u.host, '.' || l.lh)) and starts_with(u.path, l.lp))
select p.page_id, p.host, p.path, case when m.rank = 0 then m.key end as rule, coalesce(m.verdict, 'allow') as verdict
from p left join m on p.host = m.host and p.path = m.path and m.rn = 1
"""
