"""URL filter: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join.

A list entry is a host and the start of a path; it fits its host and all subdomains. Rules
(tier 1) are taken as they stand and fit any path that starts with theirs. Listed URLs
(tier 0) are canonical: scheme, user info, port, trailing dot of the host, fragment and
needless percent-escapes are gone, dot segments resolved, a last slash dropped; one fits
pages of its host whose canonical path is its own or goes on after a slash, and one with a
query fits that query alone. A list of hosts and paths instead fits, like rules, any canonical
path that starts with theirs.

For a URL what an entry fitting it can be are suffixes of its host, cut at dots, with starts
of its path: for rules those of a length that occurs among them, for listed URLs those that
end at a segment, for listed paths all. They are hashed in one pass over the URL for each suffix and probed; only
those that the Bloom filter lets through become keys, which are joined exactly with the
list, so that false hits vanish. The longest entry of the strongest tier decides. Urls are
judged once each however often they occur: the join sees distinct urls, and the answer goes
back by a join that adaptive execution splits where one url has many rows.

Defined results: a null url or one without ``://`` has an empty host and path, matches
nothing and is allowed; repeated rows give repeated results; an empty list allows all;
listed entries without a host are dropped; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import Workspace, quoted

#: Entries (host, path, verdict) that the contract fixes.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: What the list is made of where none is given: hosts named for a trade that mostly spams and a lure, under endings in wide use.
TRADES = ("ads", "adserver", "affiliate", "betting", "casino", "cheap", "click", "coupon", "crack", "diet", "dating", "escort", "forex", "free", "keygen", "loan", "lotto", "payday", "pharma", "pills", "poker", "popup", "porn", "replica", "slots", "sportsbook", "torrent", "tracker", "viagra", "warez", "webcam", "xxx")
LURES = ("best", "bets", "bonus", "buy", "club", "deals", "direct", "download", "games", "hub", "live", "now", "offers", "online", "pills", "play", "pro", "shop", "store", "top", "track", "win", "world", "zone")
ENDINGS = ("com", "net", "org", "info", "biz", "xyz", "top", "example.com", "example.net", "example.org")
#: A list whose entries take fewer bytes than this in all, by a full count, is broadcast for the join.
MOST_BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})")
PLAIN = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-._~")
#: What a canonical path or query holds as it stands.
KEPT = frozenset(PLAIN | set(b"!$&'()*+,;=:@/?%[]"))


def _escaped(text: str) -> str:
    """text with percent-escapes of plain characters undone, the others in capitals, and all else that isn't ASCII escaped."""
    raw = ESCAPE.sub(lambda m: bytes([c]) if (c := int(m[1], 16)) in PLAIN else b"%" + m[1].upper(), text.encode("utf-8", "surrogatepass"))
    return "".join(chr(b) if b in KEPT else f"%{b:02X}" for b in raw)


def canonical(url: str) -> tuple[str, str]:
    """A URL's canonical host, and its path with the query if it has one; without ``://`` it's read as if that stood before."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = re.search(r"[/?]", rest)
    host, rest = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    host = re.sub(r":[0-9]*\Z", "", host.rsplit("@", 1)[-1]).rstrip(".").lower()
    path, mark, query = rest.partition("?")
    out: list[str] = []
    for part in _escaped(path).split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return host, "".join(f"/{part}" for part in out) + (f"?{_escaped(query)}" if mark and query else "")


HOST_AND_PATH = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType())])


@F.pandas_udf(HOST_AND_PATH)
def _canonical(urls: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([canonical(u) if u else ("", "") for u in urls], columns=HOST_AND_PATH.names)


def usual_list(spark: SparkSession) -> DataFrame:
    """The list where none is given, as (url, verdict): every trade with every lure, joined or not, under every ending."""
    parts = [F.explode(F.array(*map(F.lit, x))).alias(n) for x, n in ((TRADES, "trade"), (LURES, "lure"), (("-", ""), "dash"), (ENDINGS, "ending"))]
    df = spark.range(1)
    for p in parts:
        df = df.select("*", p)
    return df.select(F.concat("trade", "dash", "lure", F.lit("."), "ending").alias("url"), F.lit("block").alias("verdict"))


def hash_of(host: str, path: str, tier: int) -> int:
    """The hash of a key, as a signed number; the prober puts it together step by step."""
    return np.int64(np.uint64(xxhash.xxh64_intdigest(f"{tier}{host}\n{path}".encode("utf-8", "surrogatepass"))).astype(np.int64))


@F.pandas_udf(T.LongType())
def _hash(host: pd.Series, path: pd.Series, tier: pd.Series) -> pd.Series:
    return pd.Series([int(hash_of(h, p, t)) for h, p, t in zip(host, path, tier)], dtype="int64")


def entries(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES, listed: DataFrame | None = None) -> DataFrame:
    """The list as (host, path, verdict, tier, h): rules, tier 1, win over listed urls, tier 0. listed: (url, verdict), or (host, path, verdict)."""
    listed = usual_list(spark) if listed is None else listed
    whole = "url" in listed.columns
    start = F.coalesce("path", F.lit("")) if not whole else F.lit("")
    start = F.when((start == "") | start.startswith("/"), start).otherwise(F.concat(F.lit("/"), start))
    listed = listed.select(_canonical("url" if whole else "host").alias("c"), start.alias("start"), "verdict")
    listed = listed.select("c.host", "c.path" if whole else F.col("start").alias("path"), "verdict", F.lit(0).alias("tier"))
    own = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    own = own.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict", F.lit(1).alias("tier"))
    # Entries that repeat a key in a tier count once; where they disagree, block wins.
    both = own.unionByName(listed).filter(F.col("host") != "").groupBy("host", "path", "tier").agg(F.max("verdict").alias("verdict"))
    return both.withColumn("h", _hash("host", "path", "tier"))


KEYS = T.ArrayType(T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("tier", T.IntegerType())]))


def _suffixes(host: str) -> list[str]:
    """A host and what is left of it after each dot."""
    return [host, *(host[m.end() :] for m in re.finditer(r"\.", host))]


def fitting(host: str, path: str, url: str, lengths: list[int], anywhere: bool = False) -> Iterator[tuple[int, str, int, int]]:
    """(hash, host, path's length, tier) of all keys that an entry fitting the URL can have: each hash goes on from the one before it."""
    for tier, own, whole in ((1, host, path), (0, *canonical(url))):
        if not own:
            continue
        cuts = [n for n in lengths if n <= len(whole)] if tier else range(len(whole) + 1) if anywhere else [0, *(m.start() for m in re.finditer(r"(?<=.)/", whole.split("?", 1)[0])), len(whole.split("?", 1)[0]), len(whole)]
        for suffix in _suffixes(own):
            h, at = xxhash.xxh64(f"{tier}{suffix}\n".encode("utf-8", "surrogatepass")), 0
            for n in sorted(set(cuts)):
                h.update(whole[at:n].encode("utf-8", "surrogatepass"))
                at = n
                yield h.intdigest(), suffix, n, tier


def prober(spark: SparkSession, bits: np.ndarray, lengths: list[int], anywhere: bool):
    """From (host, path, url) to the keys of listed entries that the URL may have: those of its own that the Bloom filter lets through."""
    shared = spark.sparkContext.broadcast((bits.astype(np.uint32), sorted(lengths)))

    @F.pandas_udf(KEYS)
    def probe(hosts: pd.Series, paths: pd.Series, urls: pd.Series) -> pd.Series:
        bits, lengths = shared.value
        out = []
        for host, path, url in zip(hosts, paths, urls):
            own = list(fitting(host, path, url, lengths, anywhere))
            yes = np.flatnonzero(bloom.hits(bits, np.array([k[0] for k in own], dtype=np.uint64))) if own else ()
            whole = (canonical(url)[1], path)
            out.append([(own[k][1], whole[own[k][3]][: own[k][2]], own[k][3]) for k in yes])
        return pd.Series(out, dtype=object)

    return probe


def judge(pages: DataFrame, listed: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: id, host, path, rule (of tier 1, else null), verdict, listed (the listed entry that decided)."""
    spark = pages.sparkSession
    the_list = Workspace(spark, "urls").keep(entries(spark, rules, listed), "list")
    stats = the_list.agg(F.count("*").alias("n"), F.sum((F.length("host") + F.length("path")) * 4 + 64).alias("bytes")).first()
    rows = pages.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(url_col)).alias("_url"))
    rows = rows.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    if not stats["n"]:
        nothing = F.lit(None).cast("string")
        return rows.select(F.col("_id").alias(id_col), "host", "path", nothing.alias("rule"), F.lit("allow").alias("verdict"), nothing.alias("listed"))
    urls = rows.filter("host != ''").select("host", "path", "_url").distinct()
    probe = prober(spark, bloom.build(the_list, "h", stats["n"], hashed=True), sorted({len(p or "") for _, p, _ in rules}), listed is not None and "url" not in listed.columns)
    possible = urls.select("_url", F.explode(probe("host", "path", "_url")).alias("k")).select("_url", "k.*")
    small = (stats["bytes"] or 0) <= MOST_BROADCAST_BYTES
    entry = the_list.select("host", "path", "tier", F.struct("tier", (F.length("host") + F.length("path")).alias("length"), "verdict", F.concat("host", "path").alias("rule")).alias("entry"))
    found = possible.join(F.broadcast(entry) if small else entry.hint("shuffle_hash"), ["host", "path", "tier"])
    best = found.groupBy("_url").agg(F.max("entry").alias("entry"))
    out = rows.join(best, "_url", "left")
    by_rule = F.col("entry.tier") == 1
    return out.select(
        F.col("_id").alias(id_col), "host", "path",
        F.when(by_rule, F.col("entry.rule")).alias("rule"),
        F.coalesce("entry.verdict", F.lit("allow")).alias("verdict"),
        F.when(~by_rule, F.col("entry.rule")).alias("listed"),
    )
