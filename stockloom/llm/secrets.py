"""Secret scan with linking of multipart credentials, in DataFrame expressions only.

Some parts of a credential are plain by themselves (assignments to secret names,
access key ids, long hex). Others are weak: an account name, a mixed token without a
name, an endpoint. A weak part is reported only when a complementary one stands within
the same scope: its neighbourhood of ``SCOPE`` code points. An account name needs a
secret, an unnamed token needs an account name, access id or endpoint, an endpoint
needs a secret. Two parts are complementary only where they do not overlap, and an unnamed
token inside an account name or endpoint is no part, but for a password after a user name
in front of the host. The neighbours are found by an interval join: parts are dealt by text
and stretch of the text, so one text with very many parts is spread as well.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from stockloom.llm.common import free_name, shuffled, written
from stockloom.llm.spans import kept, listed, overlaps, redacted, with_matches

SCOPE = 200
MARK = "[secret]"

_ASSIGN = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
_VALUE = r"(?i)^(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
#: Base kinds in the order of ties.
BASE = ("assign", "access", "hex")
#: Weak parts by role. The names of kinds in reports are the keys.
_WEAK = {
    "account": r"(?i)(?<![A-Za-z0-9])(?:user_?name|user_?id|user|login|account(?:_?id)?|client_?id|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@+/_.-]{3,}",
    "unnamed": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])",
    "endpoint": r"(?i)(?<![A-Za-z0-9])(?:https?|ftps?|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s\"'<>]+",
}
#: The user name of an endpoint with a password, an account name as well.
_LOGIN = r"(?<=://)[^\s/@:\"'<>]++(?=:[^\s/@\"'<>]+@)"


def _mixed(text: Column) -> Column:
    """Upper case, lower case and digits together: how machine-made tokens look and words do not."""
    return text.rlike("[0-9]") & text.rlike("[a-z]") & text.rlike("[A-Z]")


def _array(kind: str, spans: Column, role: str, weak: bool) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                                 F.lit(role).alias("role"), F.lit(weak).alias("weak")))


def _parts(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_base`` (arrays by kind) and ``_parts`` (kind, start, end, role, weak)."""
    col = F.col(text)
    either = col.contains("=") | col.contains(":")
    names = {
        "_assign": (_ASSIGN, either),
        "_access": (r"AKIA[A-Z0-9]{12,}+", col.contains("AKIA")),
        "_hex": (r"[0-9a-f]{32,}+", col.rlike("[0-9a-f]{32}")),
        "_account": (_WEAK["account"], either),
        "_unnamed": (_WEAK["unnamed"], col.rlike("[A-Za-z0-9+/_-]{20}")),
        "_endpoint": (_WEAK["endpoint"], col.contains("://")),
        "_login": (_LOGIN, col.contains("://") & col.contains("@")),
    }
    docs = with_matches(docs, text, names)
    docs = docs.withColumns({
        "_assign": kept("_assign", "assign", lambda t: F.length(F.regexp_extract(t, _VALUE, 1)) >= 8),
        "_access": kept("_access", "access"), "_hex": kept("_hex", "hex"), "_account": kept("_account", "account"), "_login": kept("_login", "account"),
        "_unnamed": kept("_unnamed", "unnamed", _mixed), "_endpoint": kept("_endpoint", "endpoint")})
    strong = F.concat(_array("assign", F.col("_assign"), "secret", False), _array("access", F.col("_access"), "account", False),
                      _array("hex", F.col("_hex"), "secret", False))
    # A weak match inside a base match is that match, not a part of its own.
    def outside(names: tuple[str, ...], w: Column) -> Column:
        return reduce(and_, [~overlaps(n, w) for n in names])

    def free(name: str, *more: str) -> Column:
        return F.filter(F.col(name), lambda w: outside(("_assign", "_access", "_hex", *more), w))

    # So is a token inside another weak match, unless it is a password there.
    after_login = F.transform("_login", lambda s: s["end"] + 1)
    docs = docs.withColumn("_free", free("_unnamed"))
    unnamed = F.filter("_free", lambda w: outside(("_account", "_endpoint"), w) | F.array_contains(after_login, w["start"]))
    account = F.concat(free("_account"), free("_login", "_account"))
    weak = F.concat(_array("account", account, "account", True), _array("unnamed", unnamed, "secret", True),
                    _array("endpoint", free("_endpoint"), "endpoint", True))
    return docs.withColumn("_weak", weak).withColumn("_parts", F.concat(strong, "_weak")).drop("_free")


def linked(parts: DataFrame, key: list[str], scope: int = SCOPE) -> DataFrame:
    """Weak parts with a complementary part beside them, at most ``scope`` code points away; distinct rows of key, kind, start, end.

    ``parts`` has the key columns and kind, start, end, role, weak.
    """
    stretch = F.floor(F.col("start") / scope)
    last = F.floor((F.col("end") + scope) / scope)
    weak = parts.filter("weak").withColumn("at", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("start") - scope) / scope), last)))
    # The other side lies in each stretch it touches.
    other = parts.select(*key, F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("role").alias("o_role"),
                         F.explode(F.sequence(stretch, F.floor(F.col("end") / scope))).alias("at"))
    fits = (((F.col("role") == "account") & (F.col("o_role") == "secret"))
            | ((F.col("role") == "secret") & F.col("o_role").isin("account", "endpoint"))
            | ((F.col("role") == "endpoint") & (F.col("o_role") == "secret")))
    near = (F.col("o_start") <= F.col("end") + scope) & (F.col("start") <= F.col("o_end") + scope)
    apart = (F.col("o_end") <= F.col("start")) | (F.col("end") <= F.col("o_start"))
    found = weak.join(shuffled(other.distinct()), [*key, "at"]).filter(fits & near & apart)
    return found.select(*key, "kind", "start", "end").distinct()


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per document: doc_id, text_hash, base (by start, then kind), spans (the linked ones too), and counts by kind.

    Null and empty texts have no spans. Repeated rows give a row each: rows with one
    doc_id and text share their links. A null doc_id is a key like any other.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("text_hash", F.xxhash64("text", F.col("doc_id").isNull()))
    rank = lambda s: F.transform(s, lambda x: F.struct(x["start"].alias("start"), F.when(x["kind"] == "assign", 0).when(x["kind"] == "access", 1)
                                                        .when(x["kind"] == "hex", 2).otherwise(3).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    stored = written(_parts(own, "text").select(
        "doc_id", F.coalesce("doc_id", F.lit(0)).alias("key_id"), "text_hash", F.array_sort(rank(F.concat("_assign", "_access", "_hex"))).alias("base"),
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.when((F.size("_weak") > 0) & (F.size("_parts") > 1), F.col("_parts")).alias("parts")), "secret-parts")
    key = ["key_id", "text_hash"]
    parts = stored.filter("parts IS NOT NULL").select(*key, F.explode("parts").alias("p")).select(*key, "p.*")
    more = linked(parts, key, scope).groupBy(*key).agg(F.collect_list(F.struct("start", F.lit(3).alias("rank"), "end", "kind")).alias("more"))
    alone = stored.filter("parts IS NULL").withColumn("spans", F.col("base"))
    several = stored.filter("parts IS NOT NULL").join(more, key, "left").withColumn(
        "spans", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(dict(more.dtypes)["more"]))))).drop("more")
    return alone.unionByName(several).drop("parts")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return scan(docs).select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def without_secrets(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """The documents, all columns, with every found span of ``text`` replaced by ``mark``; n_chars follows, where given."""
    hit = (scan(docs).filter(F.size("spans") > 0).groupBy("key_id", "text_hash").agg(F.first("spans").alias("spans")))
    names = {n: free_name(docs, n) for n in ("key_id", "text_hash", "spans")}
    spans = names["spans"]
    own = docs.withColumn(names["key_id"], F.coalesce("doc_id", F.lit(0))).withColumn(
        names["text_hash"], F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()))
    own = own.join(hit.select(*[F.col(k).alias(v) for k, v in names.items()]), [names["key_id"], names["text_hash"]], "left")
    clean = F.when(F.col(spans).isNull(), F.col("text")).otherwise(redacted("text", spans, mark))
    out = own.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
