"""URL filters: rules by host and path, and exact blocklist membership by a cascade of Bloom filters. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str  # begins with /

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Params:
    """bits_per_key and hashes: of each level's filter. segment_bits: a key's bits lie in one segment, chosen by its hash.
    constant_bytes: up to so many bytes, all levels together, the filters are constants of the plan; larger ones stay tables
    of segments, which keys meet by the number of their segment."""

    bits_per_key: int = 10
    hashes: int = 4
    segment_bits: int = 1 << 16
    constant_bytes: int = 16_000_000


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(host: Column, labels: int) -> Column:
    """The host and its parent domains that have at most so many labels; none for an empty host. What is cut out of the host is its end, so that
    the work is labels times what they hold, however long the host is."""
    def last(x: Column, count: Column) -> Column:
        return F.call_function("substring_index", x, F.lit("."), -count)

    end = last(host, F.lit(labels))
    n = F.length(end) - F.length(F.replace(end, F.lit("."), F.lit(""))) + 1
    return F.when((host == "") | F.lit(labels < 1), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: last(end, n + 1 - i)))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(text, action) of the longest rule that fits (ties: the longer host, then by text), null if none does."""
    out = F.lit(None).cast("struct<text:string,action:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.action).alias("action"))).otherwise(out)
    return out


@dataclass(frozen=True)
class Level:
    """A Bloom filter in segments. table: segment, bits (binary) of the segments that hold a key. whole: all segments, one
    after the other, if the cascade is small enough to be a constant."""

    number: int
    segments: int
    bits: int  # of a segment
    table: DataFrame
    whole: bytes | None

    def segment(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(-1)), F.lit(self.segments).cast("long"))

    def places(self, key: Column, hashes: int) -> list[Column]:
        """Of the key's bits in its segment."""
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(j)), F.lit(self.bits).cast("long")) for j in range(hashes)]

    def holds(self, key: Column, hashes: int) -> Column:
        """Whether the bits of a key are all set; of the constant."""
        return _set(F.lit(self.whole), self.segment(key) * (self.bits // 8), self.places(key, hashes))

    def marked(self, keys: DataFrame, hashes: int, name: str) -> DataFrame:
        """keys (key and more) with a column that says whether the bits of the key are all set; of the table."""
        spot, at = common.free_name("spot", keys.columns), common.free_name("segment", keys.columns)
        met = keys.withColumn(spot, self.segment(F.col("key"))).join(self.table.select(F.col("segment").alias(at), F.col("bits").alias(f"{at}_bits")), F.col(spot) == F.col(at), "left")
        return met.select(*keys.columns, F.coalesce(_set(F.col(f"{at}_bits"), F.lit(0), self.places(F.col("key"), hashes)), F.lit(False)).alias(name))

    def let_through(self, keys: DataFrame, hashes: int) -> DataFrame:
        """The rows of keys (key and more) whose bits are all set."""
        if self.whole is not None:
            return keys.where(self.holds(F.col("key"), hashes))
        name = common.free_name("holds", keys.columns)
        return self.marked(keys, hashes, name).where(F.col(name)).drop(name)


def _set(bits: Column, base: Column, places: list[Column]) -> Column:
    """Whether all places of a binary are set, counted from byte base. All generated code: a byte is cut out, the rest is not copied."""
    out = F.lit(True)
    for p in places:
        byte = F.conv(F.hex(F.substring(bits, (base + F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        out = out & (F.getbit(byte, (p % 8).cast("int")) == 1)
    return out


def build_level(keys: DataFrame, n: int, number: int, p: Params, room: int) -> Level:
    """The filter of n keys. Up to room bytes it is gathered, segment by segment, into one constant."""
    segments = max(1, -(-n * p.bits_per_key // p.segment_bits))
    bits = p.segment_bits if segments > 1 else max(64, -(-n * p.bits_per_key // 64) * 64)
    level = Level(number, segments, bits, keys, None)
    at = keys.select(level.segment(F.col("key")).alias("segment"), F.explode(F.array(*level.places(F.col("key"), p.hashes))).alias("at"))
    byte = at.groupBy("segment", F.floor(F.col("at") / 8).cast("int").alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("at") % 8).cast("int"))).alias("x"))
    # a segment's bytes, at most bits / 8 of them, become one binary
    there = F.map_from_entries(F.collect_list(F.struct("byte", "x")))
    filled = F.transform(F.sequence(F.lit(0), F.lit(bits // 8 - 1)), lambda i: F.lpad(F.hex(F.coalesce(F.col("there")[i], F.lit(0))), 2, "0"))
    table = byte.groupBy("segment").agg(there.alias("there")).select("segment", F.unhex(F.array_join(filled, "")).alias("bits"))
    table = common.materialize(table, f"level{number}")
    if segments * bits // 8 > room:
        return Level(number, segments, bits, table, None)
    whole = bytearray(segments * bits // 8)
    for r in table.collect():  # no more than room bytes
        whole[r["segment"] * bits // 8 : (r["segment"] + 1) * bits // 8] = r["bits"]
    return Level(number, segments, bits, table, bytes(whole))


def cascade(universe: DataFrame, p: Params) -> list[Level]:
    """The filters for universe (key, listed): level 0 holds the listed keys, level 1 the others that level 0 lets through,
    level 2 the listed ones that level 1 lets through, and so on until nothing passes wrongly. Empty if no key is listed."""
    levels: list[Level] = []
    inside, outside = universe.where("listed"), universe.where("not listed")
    n, room = inside.count(), p.constant_bytes
    while n:
        level = build_level(inside, n, len(levels), p, room)
        room -= len(level.whole) if level.whole is not None else room
        levels.append(level)
        wrong = common.materialize(level.let_through(outside, p.hashes), f"through{len(levels)}")
        inside, outside = wrong, inside
        n = inside.count()
    return levels


def decide(holds: list[Column]) -> Column:
    """Exact for every key of the universe: the first level that does not hold the key decides, else the last one."""
    out = F.lit(bool(len(holds) % 2))
    for i in range(len(holds) - 1, -1, -1):
        out = F.when(~holds[i], F.lit(bool(i % 2))).otherwise(out)
    return out


def member(key: Column, levels: list[Level], hashes: int) -> Column:
    """Whether a key is listed; of constant filters."""
    return decide([x.holds(key, hashes) for x in levels])


def members(keys: DataFrame, levels: list[Level], hashes: int) -> DataFrame:
    """The rows of keys (key and more) that are listed; of tables, which the keys meet by segment."""
    out, names = keys, []
    for x in levels:
        names.append(common.free_name(f"level{x.number}", out.columns))
        out = x.marked(out, hashes, names[-1])
    return out.where(decide([F.col(n) for n in names])).select(*keys.columns)


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], url_col: str = "url", p: Params = Params()) -> DataFrame:
    """pages with host, path, rule, listed and verdict added (underscores follow taken names).

    listed: one column of domains. A page is listed if its host or a parent domain is on the list. verdict: the action
    of the longest fitting rule, else block if listed, else allow. Null urls, urls without :// and empty hosts fit no
    rule, are not listed and so allowed. Repeated rows and repeated or null listed keys change nothing; empty tables are fine.

    The universe is every domain of every host of pages that has at most as many labels as the longest listed one (a longer one cannot be listed): hosts are made distinct first (partial aggregation, so a hot
    host is one row), and the list meets them by union and group-by. The filters of the cascade answer for every key of it. Up to
    p.constant_bytes they are constants of the plan, and pages themselves are neither shuffled nor joined. Larger filters, of
    which there may be any number, stay tables: the distinct hosts' domains meet their segments, and pages the listed hosts."""
    spark = pages.sparkSession
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    entry = F.col(listed.columns[0]).cast("string")
    labels = listed.agg(F.max(F.length(entry) - F.length(F.replace(entry, F.lit("."), F.lit(""))) + 1)).first()[0] or 0
    hosts = pages.select(host.alias("host")).distinct().select("host", F.explode(domains(F.col("host"), labels)).alias("key"))
    seen = hosts.select("key", F.lit(True).alias("seen"), F.lit(False).alias("listed"))
    entries = listed.select(entry.alias("key"), F.lit(False).alias("seen"), F.lit(True).alias("listed"))
    universe = seen.union(entries).where("key is not null").groupBy("key").agg(F.max("seen").alias("seen"), F.max("listed").alias("listed")).where("seen").select("key", "listed")
    universe = common.materialize(universe, "universe")
    names: list[str] = []
    for wanted in ("host", "path", "rule", "listed", "verdict"):
        names.append(common.free_name(wanted, [*pages.columns, *names]))
    h, w, r, m, v = names
    out = pages.withColumn(h, host).withColumn(w, path)
    levels = cascade(universe, p)
    if all(x.whole is not None for x in levels):
        out = out.withColumn(m, F.exists(domains(F.col(h), labels), lambda d: member(d, levels, p.hashes)) if levels else F.lit(False))
    else:
        bad = common.free_name("listed_host", out.columns)
        out = out.join(members(hosts, levels, p.hashes).select(F.col("host").alias(bad)).distinct(), F.col(h) == F.col(bad), "left").withColumn(m, F.col(bad).isNotNull()).drop(bad)
    rule = rule_of(F.col(h), F.col(w), rules)
    out = out.withColumn(r, rule)
    verdict = F.coalesce(F.col(f"{r}.action"), F.when(F.col(m), "block").otherwise("allow"))
    return out.select(*pages.columns, h, w, F.col(f"{r}.text").alias(r), m, verdict.alias(v))


#: The domains that the registered query lists, each of these under each of these endings.
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_ENDINGS = ("example.com", "example.net", "example.org")

#: The rules of the registered query.
RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def default_list() -> list[str]:
    return [f"{name}.{ending}" for name in LISTED_NAMES for ending in LISTED_ENDINGS]
