"""URL filters: pattern rules fetched by their rarest literal token.

A rule is a host with a path prefix (``example.net/en/``: the host, its subdomains, and
paths that start so) or a wildcard pattern over host and path (``*`` any run of
characters, ``^`` a separator or an end of the address, ``||`` a host label's start,
``|`` an end of the address). Each rule is filed under one token that every match must contain, the one
that the fewest of the given urls hold; a url's tokens fetch their rules by a join and
only fetched rules run their regular expression. Everything is DataFrame functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More rules than this are joined by a shuffle instead of a broadcast.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str         # allow or block
    base: bool = False   # base rules go before the others

    @property
    def is_path_rule(self) -> bool:
        return "/" in self.text[1:] and not re.search(r"\A/|[*^|]", self.text)

    @property
    def regex(self) -> str:
        """Over the host, a newline and the path (neither part is mistaken for the other)."""
        if self.is_path_rule:
            host, path = self.text.split("/", 1)
            return rf"\A(?:[^\n]*\.)?{re.escape(host)}\n/{re.escape(path)}"
        body, out = self.text, ""
        if body.startswith("||"):
            out, body = r"\A(?:[^\n]*\.)?", body[2:]
        elif body.startswith("|"):
            out, body = r"\A", body[1:]
        elif body.startswith("^"):  # the address may begin here
            out, body = r"(?:\A|[^a-z0-9])", body[1:]
        end = body.endswith("|")
        for c in body[:-1] if end else body:
            out += {"*": r"[\s\S]*", "^": r"(?:[^a-z0-9]|\z)", "/": r"\n?/"}.get(c) or re.escape(c)
        return out + (r"\z" if end else "")

    @property
    def tokens(self) -> list[str]:
        """Lower-case tokens that every matching url holds whole: those shut in by other literal characters or ends."""
        body = self.text.lower()
        if self.is_path_rule:
            shut = "/" + body + "*"
        else:
            shut = ("/" + body[2:] if body.startswith("||") else "/" + body[1:] if body.startswith("|") else "*" + body)
            shut = shut[:-1] + "/" if body.endswith("|") else shut + "*"
        return sorted(set(re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", shut)))


#: The stated base rules.
BASE_RULES = (Rule("net/", "block", True), Rule("example.net/en/", "allow", True),
              Rule("example.com/de/", "block", True), Rule("org/fr/", "allow", True))
#: The method's own: junk hosts, machine paths, and an exception.
PATTERN_RULES = (
    Rule("^spam-", "block"), Rule("-spam^", "block"), Rule("^spam^", "block"), Rule("^cheap-*pills^", "block"),
    Rule("^pills^", "block"), Rule("^casino^", "block"), Rule("^free-money^", "block"), Rule("^adult^", "block"),
    Rule("^xxx^", "block"), Rule("/wp-admin/", "block"), Rule("/cgi-bin/", "block"), Rule("^spam-policy^", "allow"),
)


def lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; path: then up to
    ``?``, ``#`` or the end. A null url, or one without ``://``, has both empty."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    return (F.coalesce(lowered(host), F.lit("")),
            F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit("")))


def url_tokens(address: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lowered(address), F.lit("[a-z0-9]+"), F.lit(0)))


def filed(spark, tokens: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The rules, each under its rarest token in ``tokens`` (one row per url and token).

    Counts cover all urls; only the rules' own tokens are counted. A rule without a sure token has
    the empty one, which every url fetches.
    """
    number = spark.createDataFrame([(i, t) for i, r in enumerate(rules) for t in r.tokens] or [(-1, "")], "rule_no int, token string")
    counts = tokens.join(F.broadcast(number.select("token").distinct()), "token").groupBy("token").count()
    best = (number.join(counts, "token", "left").groupBy("rule_no")
            .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("urls"), "token"))["token"].alias("token")))
    table = spark.createDataFrame([(i, r.text, r.verdict, r.base, r.regex, len(r.text)) for i, r in enumerate(rules)],
                                  "rule_no int, rule string, rule_verdict string, is_base boolean, regex string, size int")
    return table.join(best, "rule_no", "left").withColumn("token", F.coalesce("token", F.lit("")))


def hits(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Per url with a matching rule: the best base rule and the best other rule (structs, null where none).

    ``urls``: distinct urls with host and path. The longest rule wins, then block, then the smaller text.
    """
    spark = urls.sparkSession
    address = F.concat_ws("\n", "host", "path")
    tokens = urls.select("url", address.alias("address"), F.explode(F.array_append(url_tokens(address), "")).alias("token"))
    index = filed(spark, tokens.select("token"), rules)
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    found = tokens.join(index, "token").where(F.expr("address RLIKE regex"))
    order = F.struct(-F.col("size"), F.col("rule_verdict") == "allow", "rule")
    pick = lambda base: F.min_by(F.when(F.col("is_base") == base, F.struct("rule", "rule_verdict")),
                                 F.when(F.col("is_base") == base, order))
    return found.groupBy("url").agg(pick(True).alias("base_hit"), pick(False).alias("own_hit"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + PATTERN_RULES, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule, verdict and pattern; columns of these names are replaced.

    rule: the longest base rule that fits, else null; verdict: that rule's, else the longest fitting
    pattern's (kept in ``pattern``), else ``default``. Each distinct url is judged once, and every row
    of ``pages`` gets its url's verdict, repeated rows included. A null or malformed url has an empty
    host and path, fits no host rule and gets the default unless a pattern fits the empty address.
    """
    own = pages.drop("host", "path", "rule", "verdict", "pattern")
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.coalesce("url", F.lit("")).alias("url")).distinct()
    urls = urls.select("url", host.alias("host"), path.alias("path"))
    judged = hits(urls, rules).withColumnRenamed("url", "__url")
    out = own.join(judged, F.coalesce(own["url"], F.lit("")) == F.col("__url"), "left")
    return out.select(*[own[c] for c in own.columns], host.alias("host"), path.alias("path"),
                      F.col("base_hit.rule").alias("rule"),
                      F.coalesce("base_hit.rule_verdict", "own_hit.rule_verdict", F.lit(default)).alias("verdict"),
                      F.col("own_hit.rule").alias("pattern"))


def page_verdicts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict and the pattern that fits best."""
    return filter_urls(pages.select("page_id", "url")).drop("url")


def page_verdicts_sql() -> str:
    """The same result in DuckDB SQL, by plain tests of every rule on every url."""
    # host and path rules as suffix and prefix tests; patterns as regular expressions
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    longest = sorted(BASE_RULES, key=lambda r: (-len(r.text), r.verdict == "allow", r.text))
    fits = {r: f"((host = {quote(h)} OR ends_with(host, {quote('.' + h)})) AND starts_with(path, {quote('/' + p)}))"
            for r in longest for h, p in [r.text.split("/", 1)]}
    best = " ".join(f"WHEN {fits[r]} THEN {quote(r.text)}" for r in longest)
    verdict = " ".join(f"WHEN rule = {quote(r.text)} THEN {quote(r.verdict)}" for r in longest)
    # a pattern's `^` as a character around the address, told in plain conditions and not by Rule.regex
    other = [("^spam-policy^", "allow", "regexp_matches(shut, '[^a-z0-9]spam-policy[^a-z0-9]')"),
             ("^cheap-*pills^", "block", "regexp_matches(shut, '[^a-z0-9]cheap-(.|\\n)*pills[^a-z0-9]')"),
             ("^free-money^", "block", "regexp_matches(shut, '[^a-z0-9]free-money[^a-z0-9]')"),
             ("/wp-admin/", "block", "contains(path, '/wp-admin/')"), ("/cgi-bin/", "block", "contains(path, '/cgi-bin/')"),
             ("^casino^", "block", "list_contains(parts, 'casino')"), ("^adult^", "block", "list_contains(parts, 'adult')"),
             ("^pills^", "block", "list_contains(parts, 'pills')"),
             ("-spam^", "block", "regexp_matches(shut, '-spam[^a-z0-9]')"), ("^spam-", "block", "regexp_matches(shut, '[^a-z0-9]spam-')"),
             ("^spam^", "block", "list_contains(parts, 'spam')"), ("^xxx^", "block", "list_contains(parts, 'xxx')")]
    pattern = " ".join(f"WHEN {test} THEN {quote(text)}" for text, _, test in sorted(other, key=lambda r: (-len(r[0]), r[1] == "allow", r[0])))
    theirs = " ".join(f"WHEN pattern = {quote(text)} THEN {quote(verdict)}" for text, verdict, _ in other)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{upper}', '{lower}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, ' ' || host || chr(10) || path || ' ' AS shut, regexp_split_to_array(host || chr(10) || path, '[^a-z0-9]') AS parts,
                 CASE {best} END AS rule FROM parts),
fitted AS (SELECT *, CASE {pattern} END AS pattern FROM ruled)
SELECT page_id, host, path, rule, CASE {verdict} {theirs} ELSE 'allow' END AS verdict, pattern FROM fitted"""
