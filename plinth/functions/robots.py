"""Rules of a robots text as rows, and which of them hold for an agent and a path."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


@udtf(returnType="agent string, allow boolean, path string, crawl_delay double")
class RobotsRules:
    """One row a rule. Agent lines that follow each other share the rules after them; a delay is a row without a path."""

    def eval(self, text: str) -> Iterator[tuple]:
        agents: list[str] = []
        in_rules = False
        for line in (text or "").splitlines():
            name, found, value = line.split("#", 1)[0].partition(":")
            name, value = name.strip().lower(), value.strip()
            if not found:
                continue
            if name == "user-agent":
                agents = [value.lower()] if in_rules else [*agents, value.lower()]
                in_rules = False
            elif name in ("allow", "disallow", "crawl-delay"):
                in_rules = True
                for agent in agents:
                    if name != "crawl-delay":
                        if value:
                            yield agent, name == "allow", value, None
                    elif value.replace(".", "", 1).isdigit():
                        yield agent, None, None, float(value)


def register(spark: SparkSession) -> None:
    spark.udtf.register("robots_rules", RobotsRules)


def verdicts(requests: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """requests (origin, path) with allowed and crawl_delay, by rules (origin, agent, allow, path, crawl_delay).

    The group of the longest agent name that begins the agent's counts, else that of *; the longest matching path wins, and
    allow wins ties. No rule allows.
    """
    mine = rules.where((F.col("agent") == "*") | F.startswith(F.lit(agent.lower()), F.col("agent")))
    rank = F.when(F.col("agent") == "*", -1).otherwise(F.length("agent"))
    best = mine.groupBy("origin").agg(F.max(rank).alias("best"))
    chosen = mine.join(best, "origin").where(rank == F.col("best"))
    delays = chosen.groupBy("origin").agg(F.max("crawl_delay").alias("crawl_delay"))
    keyed = requests.distinct()
    hits = keyed.join(chosen.where("path is not null").select("origin", F.col("path").alias("rule"), "allow"), "origin").where(F.startswith(F.col("path"), F.col("rule")))
    won = hits.groupBy("origin", "path").agg(F.max_by("allow", F.struct(F.length("rule"), "allow")).alias("rule_allows"))
    return requests.join(won, ["origin", "path"], "left").join(delays, "origin", "left").withColumn("allowed", F.coalesce("rule_allows", F.lit(True))).drop("rule_allows")


def answered(requests: DataFrame, fetches: DataFrame, ttl: int = 86_400, fail_closed: bool = True) -> DataFrame:
    """requests (origin, at) with what the newest robots.txt fetched by then says: mode, reason and whether it is fresh.

    fetches: origin, fetched_at and status, null where the host was not reached. A file (200) is to be parsed; a host that
    isn't reached, or answers 429 or 5xx, disallows all if fail_closed; any other answer allows all. Answers stay fresh for ttl
    seconds, failures for a twelfth of it (a minute at least). An origin without a fresh answer is to be fetched first.
    """
    status = F.col("_f.status")
    lost = status.isNull() | (status == 429) | (status >= 500)
    asks = requests.withColumns({"_f": F.lit(None).cast("struct<status:int,fetched_at:bigint>"), "_at": F.col("at").cast("bigint"), "_asks": F.lit(1)})
    gets = fetches.select("origin", F.struct(F.col("status").cast("int").alias("status"), F.col("fetched_at").cast("bigint").alias("fetched_at")).alias("_f"), F.col("fetched_at").cast("bigint").alias("_at"), F.lit(0).alias("_asks"))
    both = asks.unionByName(gets, allowMissingColumns=True)
    before = Window.partitionBy("origin").orderBy("_at", "_asks", "_f.status")
    seen = both.withColumn("_f", F.last("_f", ignorenulls=True).over(before)).where("_asks = 1")
    fresh = F.col("_at") - F.col("_f.fetched_at") < F.when(lost, F.lit(max(60, ttl // 12))).otherwise(F.lit(ttl))
    known = F.col("_f").isNotNull()
    mode = F.when(~known | ~fresh, "fetch").when(status == 200, "parse").when(lost, "disallow_all" if fail_closed else "allow_all").otherwise("allow_all")
    reason = F.when(~known | ~fresh, "robots_stale").when(status == 200, "robots_parsed").when(status.isNull(), "robots_unreachable").when(lost, F.concat(F.lit("robots_unreachable:http_"), status)).otherwise(F.concat(F.lit("robots_unavailable:http_"), status))
    return seen.withColumns({"mode": mode, "reason": reason}).select(*requests.columns, "mode", "reason")
