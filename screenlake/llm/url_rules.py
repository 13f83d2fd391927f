"""URL filters: pattern rules indexed by their rarest literal token. DataFrame functions only.

A rule is a pattern with wildcards, anchors and alternatives. Each of its branches has literal tokens that every url it
fits surely holds, and is filed under the one of them that the fewest urls hold. The tokens of urls are joined with
that index, and only the rules that this fetches run their regular expressions. Rules are a table: their number is
bounded by no plan. Rules of a domain and a path prefix are turned into such patterns too.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``branches``: for each way to fit, the maximal runs of [A-Za-z0-9] that a fitting url surely has as tokens.
    ``exact``: the expression runs on host, line feed and path as they are; else on host and path in lower case."""

    name: str
    pattern: str
    branches: tuple[tuple[str, ...], ...]
    verdict: str
    rank: int
    exact: bool = False


def prefix_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; the longest rule has the highest rank."""
    whole = re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    tokens = tuple(dict.fromkeys([*re.findall(r"[a-z0-9]+", host), *whole]))
    return Rule(host + path, rf"^([^/]*\.)?\Q{host}\E\n\Q{path}\E", (tokens,), verdict, 1000 + len(host + path), True)


#: Signs of a pattern and what they stand for; everything else is itself.
SIGNS = {"||": r"^([^/]*\.)?", "*": ".*", "^": r"(^|[^a-z0-9]|\z)", "|": None}


def pattern_rule(text: str) -> Rule:
    """A rule in the manner of filter lists, case apart: ``||`` begins at a label of the host, ``|`` is the start or
    the end of host and path, ``^`` an end or a character other than a letter or digit, ``*`` anything, ``{a,b}``
    alternatives. Rules block; those after ``@@`` allow, and win."""
    allow = text.startswith("@@")
    body = text.removeprefix("@@").lower()
    parts = re.findall(r"\{[^{}]*\}|\|\||[*^|]|[^*^|{}]+", body)
    options = [p[1:-1].split(",") if p[0] == "{" else [p] for p in parts]
    regex = []
    for i, (p, o) in enumerate(zip(parts, options)):
        if p == "|":
            regex.append("^" if i == 0 else r"\z")
        elif p in SIGNS:
            regex.append(SIGNS[p])
        else:
            each = [re.sub(r"[.+?()\[\]\\$]", r"\\\g<0>", x) for x in o]
            regex.append(f"({'|'.join(each)})" if len(o) > 1 else each[0])
    branches = []
    for choice in itertools.product(*options):
        # a sign other than * parts tokens; at an open end a run may go on
        line = "".join("." if p in ("||", "|", "^") else "*" if p == "*" else p for p in choice)
        found = tuple(dict.fromkeys(re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", line)))
        if not found:
            raise ValueError(f"no whole token is sure in {text!r}")
        branches.append(found)
    return Rule(text, "(?s)" + "".join(regex), tuple(dict.fromkeys(branches)), "allow" if allow else "block", 2 if allow else 1)


#: The rules of the query's contract.
CONTRACT = (
    prefix_rule("com", "/en/", "block"),
    prefix_rule("example.com", "/en/7", "allow"),
    prefix_rule("net", "/de/", "allow"),
    prefix_rule("example.net", "/de/8", "block"),
    prefix_rule("org", "/es/", "block"),
)
#: Urls that publish no prose worth keeping: unsolicited sales, gambling, adult content, stolen software, adverts, and
#: pages that are forms, scripts or lists. Articles about these things are allowed.
FILTERS = tuple(pattern_rule(x) for x in (
    "^{spam,malware,phishing}^",
    "^{casino,poker,betting,jackpot,roulette,sportsbook}^",
    "^{porn,xxx,escort}^",
    "^{viagra,pharmacy,replica,pills}^",
    "^{buy,cheap,order}^*^{online,now,discount}^",
    "^payday^{loan,loans,advance}^",
    "^{warez,keygen,torrent}^",
    "^{crack,serial}^*^{download,free}^",
    "||{ads,adserver,banners,tracker}.",
    "||click*^redirect/",
    "/{login,signin,signup,register,logout}{,/,.php,.html,.aspx}|",
    "/{cart,basket,checkout}{,/}|",
    "/wp-{login,cron,signup}.php",
    "/cgi-bin/*.{exe,pl,cgi}|",
    "/tag/*/page/",
    "/search/*/results/",
    "|www.*/feed/|",
    "@@/wiki/",
    "@@^{history,museum,encyclopedia}^of^",
))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(host: Column, path: Column) -> Column:
    t = F.split(F.concat(host, F.lit("/"), path), "[^A-Za-z0-9]+")
    return F.array_distinct(F.concat(t, F.transform(t, F.lower)))


def subject(host: Column, path: Column) -> Column:
    return F.translate(F.concat(host, path), UPPER, LOWER)


def table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """name, rank, pattern, verdict, exact, branch, tokens: one row for each branch of each rule."""
    rows = [F.struct(F.lit(r.name).alias("name"), F.lit(r.rank).alias("rank"), F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"), F.lit(r.exact).alias("exact"), F.lit(k).alias("branch"),
                     F.array(*map(F.lit, b)).alias("tokens")) for r in rules for k, b in enumerate(r.branches)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` with the ``token`` of each branch that the fewest of the urls (host, path) hold. Only tokens of rules
    are counted, before any shuffle."""
    each = rules.select("name", "branch", F.explode("tokens").alias("token"))
    held = urls.select(F.explode(tokens(F.col("host"), F.col("path"))).alias("token"))
    seen = held.join(each.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = each.join(seen, "token", "left").groupBy("name", "branch").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))
    return rules.drop("tokens").join(rarest, ["name", "branch"])


def judge(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = (*CONTRACT, *FILTERS), url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` plus host, path, rule, verdict and the number of rules whose expressions ran (n_tried).

    ``rules``: a tuple, or a table as ``table`` makes it, of any number of rows. Null urls and urls without ``://`` have
    an empty host and path and get ``default``, as has a url that no rule fits. Urls of one host and path are judged
    once. Repeated rows give repeated results; an empty table an empty one. Input columns named like an output are
    replaced. The rank decides between fitting rules, then the name. ``rule`` names prefix rules only.
    """
    clash = [c for c in ("host", "path", "rule", "verdict", "n_tried") if c in pages.columns]
    host, path = parts(F.col(url))
    df = pages.withColumns({"__host": host, "__path": path}).drop(*clash).withColumnsRenamed({"__host": "host", "__path": "path"})
    known = rules if isinstance(rules, DataFrame) else table(pages.sparkSession, rules)
    urls = df.select("host", "path")
    asked = urls.withColumn("token", F.explode(tokens(F.col("host"), F.col("path")))).join(index(urls, known), "token")
    text = F.when(F.col("exact"), F.concat("host", F.lit("\n"), "path")).otherwise(subject(F.col("host"), F.col("path")))
    fit = F.when(F.regexp_like(text, F.col("pattern")), F.struct("rank", "name", "verdict"))
    found = asked.groupBy("host", "path").agg(F.max(fit).alias("__fit"), F.size(F.collect_set("name")).alias("__tried"))
    df = df.join(found, ["host", "path"], "left")
    return df.select(*[F.col(f"`{c}`") for c in pages.columns if c not in clash], "host", "path", F.when(F.col("__fit.rank") >= 1000, F.col("__fit.name")).alias("rule"),
                     F.coalesce("__fit.verdict", F.lit(default)).alias("verdict"), F.coalesce("__tried", F.lit(0)).alias("n_tried"))


ORACLE = r"""
WITH p AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
f AS (SELECT page_id, arg_max(h || r.p, length(h || r.p)) AS rule, arg_max(v, length(h || r.p)) AS v
      FROM q JOIN r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.p) GROUP BY page_id)
SELECT q.page_id, q.host, q.path, f.rule, coalesce(f.v, (SELECT arg_max(w.v, w.rank) FROM (VALUES FILTERS) w(pattern, v, rank) WHERE regexp_matches(translate(q.host || q.path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), w.pattern)), 'allow') AS verdict
FROM q LEFT JOIN f USING (page_id)
""".replace("FILTERS", ", ".join(f"('{r.pattern}', '{r.verdict}', {r.rank})" for r in FILTERS))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
