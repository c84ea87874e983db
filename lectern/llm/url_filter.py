"""URL verdicts from host and path rules, and from patterns indexed by their rarest literal token.

A pattern can only match a URL that holds each of its literal tokens. How often those tokens occur is counted over
all different URLs, every pattern is filed under its rarest one, and a URL's own tokens fetch the candidates by a hash
join; regular expressions run for these alone. A list of tens of thousands of patterns costs a URL no more than the
few it fetches. Everything is a DataFrame expression. What is shuffled are counts of tokens, different URLs and the URLs that match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import durable
from lectern.operators.sizes import small


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Pattern:
    """A regular expression on the lower-cased URL, with the literal tokens that any match must hold as whole tokens."""

    verdict: str
    tokens: tuple[str, ...]
    regex: str


HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)


#: What stands for a separator in a regular expression; letters, digits and these signs are none.
SEPARATOR = "([^a-z0-9_.%-]|$)"


def phrase(verdict: str, *tokens: str) -> Pattern:
    """The tokens in this order, with one or more separators between them, as whole tokens."""
    return Pattern(verdict, tokens, "(^|[^a-z0-9])" + "[^a-z0-9]+".join(tokens) + "([^a-z0-9]|$)")


def rule(line: str) -> Pattern:
    """A pattern from a filter line.

    `*` stands for anything, `^` for a separator or the end. `||` at the start anchors to a host or one of its subdomains,
    `|` at the start or the end to the URL's. `@@` in front makes an exception: where it matches, no pattern blocks. The tokens
    are the runs of letters and digits that are whole in any match: not beside `*` or an open end.
    """
    text, verdict = line.strip().lower(), "block"
    if text.startswith("@@"):
        text, verdict = text[2:], "allow"
    host, start = text.startswith("||"), text.startswith("|")
    text = text[2:] if host else text[1:] if start else text
    end = text.endswith("|")
    body = text[:-1] if end else text
    if not body.strip("*"):
        raise ValueError(f"the rule {line!r} would match every URL")
    signs = {"*": "(?s:.*)", "^": SEPARATOR}
    regex = "".join(signs.get(c) or (c if re.fullmatch("[a-z0-9]", c) else "\\" + c if ord(c) < 128 and not c.isspace() else re.escape(c)) for c in body)
    head = "^[a-z][a-z0-9+.-]*://([^/?#]*[.])?" if host else "^" if start else ""
    closed_left, closed_right = host or start, end
    tokens = [m.group() for m in re.finditer("[a-z0-9]+", body) if (m.start() > 0 or closed_left) and (m.end() < len(body) or closed_right) and "*" not in body[max(0, m.start() - 1) : m.start()] + body[m.end() : m.end() + 1]]
    return Pattern(verdict, tuple(dict.fromkeys(tokens)), head + regex + ("$" if end else ""))


#: What the method blocks, as phrases and as filter lines.
BLOCKED_PHRASES = (
    ("cheap", "pills"), ("spam", "farm"), ("adult", "x"), ("casino",), ("free", "casino"), ("online", "poker"), ("payday", "loans"),
    ("porn",), ("xxx", "video"), ("viagra",), ("cialis",), ("replica", "watches"), ("torrent", "download"), ("free", "movies"),
    ("warez",), ("keygen",), ("crack", "serial"), ("link", "farm"), ("escort",), ("sex", "cams"), ("betting", "odds"),
    ("miracle", "cure"), ("weight", "loss", "pills"), ("work", "from", "home"), ("click", "bait"), ("malware",), ("phishing",),
)
FILTER_LINES = (
    "||ads.*^", "||adserver.", "||doubleclick.net^", "||track.", "/banners/", "/ads/*.js", "/adserver/", "/popunder", "/sponsored/*/click", "^affiliate_id=", "^utm_content=ad^",
    "/wp-login.php", "/cgi-bin/*.cgi|", "/phpmyadmin/", "/xmlrpc.php|", "||bit.ly^", "||tinyurl.com^", "/redirect?*url=http", "/out.php?*to=", "/login?*next=", "/cart/add/", "/checkout/",
    "/calendar/*/print^", "^sessionid=", "^phpsessid=", "^jsessionid=", "/tag/*/page/", "/search?*q=", "/feed/|", "/trackback/|", "/amp/|", "|ftp://", "|mailto:", "|javascript:",
    ".exe|", ".zip|", ".iso|", ".dmg|", ".apk|", ".torrent|", "/download/*.rar", "/gambling/", "/lottery/*/win", "||*.click^", "||*.loan^", "||*.xxx^", "||*.bid^", "/hentai/", "/nsfw/", "/hookup/",
    "@@/health/*/casino-safety", "@@||library.*^", "@@/security/malware-analysis/", "@@/research/phishing^", "@@/news/*/search?", "@@||archive.org^",
)
PATTERNS = tuple(phrase("block", *tokens) for tokens in BLOCKED_PHRASES) + tuple(map(rule, FILTER_LINES))

TOKEN_SEPARATOR = "[^a-z0-9]+"


def lowered(text: Column) -> Column:
    """A-Z alone are lower-cased."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    return F.split(lowered(F.coalesce(url, F.lit(""))), TOKEN_SEPARATOR)


def host_rule(host_of: Column, path_of: Column, rules: tuple[HostRule, ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    said: Column | None = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host_of == r.host) | host_of.endswith("." + r.host)) & path_of.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        said = F.when(fits, value) if said is None else said.when(fits, value)
    return said if said is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def rule_table(spark: SparkSession, patterns: tuple[Pattern, ...]) -> DataFrame:
    """verdict, tokens and regex of patterns given in code, as rows."""
    if not patterns:
        return spark.range(0).select(F.lit("").alias("verdict"), F.array().cast("array<string>").alias("tokens"), F.lit("").alias("regex"))
    row = lambda p: F.struct(F.lit(p.verdict).alias("verdict"), F.array(*map(F.lit, p.tokens)).cast("array<string>").alias("tokens"), F.lit(p.regex).alias("regex"))
    return spark.range(1).select(F.inline(F.array(*map(row, patterns))))


def file_rules(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """token, verdict and regex: every rule under the one of its tokens that the fewest URLs hold (ties: the smallest), or under the empty one if it has none.

    tokens: url and token of different URLs. Only the rules' own tokens are counted, and summed before the shuffle.
    """
    wanted = rules.select("verdict", "regex", F.explode_outer("tokens").alias("token"))
    counts = tokens.join(small(wanted.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)), F.coalesce("token", F.lit("")).alias("token")))
    return wanted.join(counts, "token", "left").groupBy("verdict", "regex").agg(rarest.alias("r")).select("r.token", "verdict", "regex")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url and patterns (array<struct<verdict, regex>>) of the URLs that any rule matches.

    Each different URL is taken once. Its tokens fetch the rules filed under them by a hash join, whose side of
    rules is sent to the executors if it is small; regular expressions run for the fetched ones alone.
    """
    once = urls.filter("url is not null").distinct()
    tokens = once.select("url", F.explode(F.array_distinct(F.concat(url_tokens(F.col("url")), F.array(F.lit(""))))).alias("token"))
    filed = durable(file_rules(tokens, rules))
    fetched = tokens.join(small(filed), "token").filter(F.rlike(lowered(F.col("url")), F.col("regex")))
    return fetched.groupBy("url").agg(F.array_sort(F.collect_set(F.struct("verdict", "regex"))).alias("patterns"))


def judge(pages: DataFrame, host_rules: tuple[HostRule, ...] = HOST_RULES, patterns: tuple[Pattern, ...] | DataFrame = PATTERNS, column: str = "url") -> DataFrame:
    """Adds host, path, rule (of the host rules, else null), patterns (the matching ones) and verdict (allow or block).

    patterns are given in code, or as a table (verdict, tokens, regex) of any size. The host rule's verdict stands; without
    one the patterns decide: one that blocks blocks, unless one that allows matches too. A null URL, or
    one without `://`, has an empty host and path; it is judged by the patterns, and a null one is allowed.
    Columns of these names are replaced; repeated rows repeat; an empty table gives an empty result.
    """
    rules = patterns if isinstance(patterns, DataFrame) else rule_table(pages.sparkSession, patterns)
    found = durable(matches(pages.select(F.col(column).alias("url")), rules))
    hit = small(found.select(F.col("url").alias("_url"), F.col("patterns").alias("_patterns")))
    joined = pages.join(hit, F.col(column) == F.col("_url"), "left").drop("_url")
    url = F.col(column)
    out = joined.withColumns({"host": host(url), "path": path(url)})
    none = F.array().cast("array<struct<verdict:string,regex:string>>")
    out = out.withColumns({"_host_rule": host_rule(F.col("host"), F.col("path"), host_rules), "patterns": F.coalesce("_patterns", none)}).drop("_patterns")
    said = lambda verdict: F.exists("patterns", lambda p: p["verdict"] == verdict)
    own = F.when(said("block") & ~said("allow"), "block").otherwise("allow")
    return out.withColumns({"rule": F.col("_host_rule.rule"), "verdict": F.coalesce(F.col("_host_rule.verdict"), own)}).drop("_host_rule")


def sql(host_rules: tuple[HostRule, ...] = HOST_RULES, patterns: tuple[Pattern, ...] = PATTERNS) -> str:
    """The same for DuckDB: every pattern on every URL, without the index."""
    ordered = sorted(host_rules, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in ordered) + " END"
    lower = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    any_of = lambda verdict: " OR ".join(f"regexp_matches({lower}, '{p.regex}')" for p in patterns if p.verdict == verdict) or "false"
    return f"""
WITH split_urls AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, {case(lambda r: r.name)} AS rule,
       coalesce({case(lambda r: r.verdict)}, CASE WHEN ({any_of('block')}) AND NOT ({any_of('allow')}) THEN 'block' ELSE 'allow' END) AS verdict
FROM split_urls"""
