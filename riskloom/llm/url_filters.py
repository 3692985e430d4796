"""URL filters with redirect equivalence. Only DataFrame functions.

Rules judge an address by host and path. Addresses joined by redirects or canonical links are one
resource: a block decision reaches all its aliases, unless an allow rule names one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.components import connected_components
from riskloom.runtime import store

# (verdict, host and path): a rule fits its host, all subdomains, and paths that start with its own.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# canonical may stand anywhere in the list of a rel
LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*(?:canonical\b|"[^">]*\bcanonical\b|'[^'>]*\bcanonical\b))[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""
ORIGIN = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest fitting rule as a struct ``verdict, rule``, or NULL. The first listed wins a tie."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        named = (host == name) | host.endswith(f".{name}")
        fits.append(F.when(named & path.startswith(f"/{rest}"), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*fits)


def address(url: Column) -> Column:
    """The node of an address in the alias graph: without its fragment, which no server sees.

    A-Z of scheme and host are folded, and the path's ``.`` and ``..`` segments are resolved.
    """
    plain = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    origin = F.regexp_extract(plain, ORIGIN, 0)
    rest = F.substring(plain, F.length(origin) + 1, F.length(plain))
    way = F.regexp_extract(rest, r"(?s)^[^?]*", 0)
    query = F.substring(rest, F.length(way) + 1, F.length(rest))
    dotted = (origin != "") & F.contains(way, F.lit("/."))
    return F.when(plain.isNotNull(), F.concat(F.translate(origin, UPPER, LOWER), F.when(dotted, _without_dots(way)).otherwise(way), query))


def _without_dots(way: Column) -> Column:
    """A path from ``/`` on without ``.`` and ``..`` segments; ``..`` stops at the root."""
    parts = F.split(way, "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), empty,
        lambda have, x: F.when(x == ".", have).when(x == "..", F.slice(have, 1, F.greatest(F.size(have) - 1, F.lit(0)))).otherwise(F.array_append(have, x)),
    )
    last = F.element_at(parts, -1)
    return F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/"))


def alias_edges(pages: DataFrame) -> DataFrame:
    """``a, b``: an address and the one its page redirects to (refresh) or names as canonical.

    Targets are resolved against the page: ``//host/..`` and ``/path`` take the page's scheme or origin;
    others without a scheme are paths beside the page. All such links of a page count. Pages without one give no row.
    """
    base = F.col("url")
    origin = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*(?:[^?#]*/)?)", 1)
    found = pages.filter(F.col("url").isNotNull()).select(
        "url", F.explode(F.concat(*[F.coalesce(F.regexp_extract_all("html", F.lit(rx), 1), F.array().cast("array<string>")) for rx in (LINK, REFRESH)])).alias("to")
    ).filter("to <> ''")
    to = F.replace(F.col("to"), F.lit("&amp;"), F.lit("&"))
    full = (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/?#]+:)", 1), to))
        .when(to.startswith("/"), F.concat(origin, to))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), to))
    )
    return found.select(address(base).alias("a"), address(full).alias("b")).filter("a <> b")


def judge(pages: DataFrame, edges: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, via`` for each page row.

    A page's own rule decides. Without one, the page takes the decision of its aliases: allow if any
    address of its component is allowed by a rule, else block if any is blocked by one. All others
    are allowed. ``via`` says which: ``rule``, ``alias`` or ``default``. ``edges`` (``a, b``) are addresses; they may
    name addresses that are no page, whose rules count as well. NULL urls fit no rule and have no
    alias; repeated rows are judged alike; without edges nothing is shuffled.
    """
    u = F.col("url")
    judged = pages.select("page_id", "url", host(u).alias("host"), path(u).alias("path")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    nodes = connected_components(edges).select("node", "component")
    own = rule_of(host(F.col("node")), path(F.col("node")), rules)
    # allow sorts before block, so that the least verdict is the allowed one
    by_component = store(nodes.groupBy("component").agg(F.min(own["verdict"]).alias("shared")).filter("shared IS NOT NULL"))
    aliases = store(nodes.join(by_component, "component").select("node", "shared"))
    if aliases.isEmpty():
        shared = judged.withColumn("shared", F.lit(None).cast("string"))
    else:
        shared = judged.withColumn("node", address(u)).join(aliases, "node", "left")
    return shared.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "shared", F.lit("allow")).alias("verdict"),
        F.when(F.col("fit").isNotNull(), "rule").when(F.col("shared").isNotNull(), "alias").otherwise("default").alias("via"),
    )
