"""Operator 5, URL filters: rules indexed by their rarest literal token.

Every rule is a regular expression over ``host + path`` plus the literal
tokens (runs of a-z, 0-9) that any URL it fits must contain whole.  The index
files each rule under one of these, the one that occurs in the fewest URLs of
the table.  A URL's own tokens fetch the candidate rules; only those run.

The index holds the rules, never the URLs; it travels with the task closure
and its size is the size of the rule list given by the caller.  The URL pass
has no shuffle, so hot hosts cannot skew it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrostar.llm.common import LOWER_TABLE, arrow_pass, lower_ascii

ALLOW, BLOCK = "allow", "block"
_TOKEN = re.compile(r"[a-z0-9]+")
_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class SiteRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    action: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return rf"(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    @property
    def tokens(self) -> tuple[str, ...]:
        # The path's last run may go on in the URL unless something ends it.
        whole = self.name if self.name[-1:] and not self.name[-1].isalnum() else _cut_last(self.name)
        return tuple(dict.fromkeys(_TOKEN.findall(_lower(whole))))


@dataclass(frozen=True)
class PhraseRule:
    """Fits where ``phrase`` stands in host or path between token borders, A-Z
    read as a-z."""

    phrase: str
    action: str = BLOCK

    @property
    def regex(self) -> str:
        return rf"(?s:.*?)(?<![a-z0-9]){re.escape(_lower(self.phrase))}(?![a-z0-9])"

    @property
    def tokens(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(_TOKEN.findall(_lower(self.phrase))))


@dataclass(frozen=True)
class PatternRule:
    """A wildcard pattern over host and path, A-Z read as a-z.

    ``*`` stands for any characters and ``^`` for one that is none of letters,
    digits and ``_-.%``, or for the end; ``||`` in front ties the pattern to
    the start of the host or of one of its parent domains, ``|`` in front to
    the start of the host, ``|`` behind to the end of the path."""

    pattern: str
    action: str = BLOCK

    @property
    def _parts(self) -> tuple[str, str, bool]:
        body = _lower(self.pattern)
        front = "||" if body.startswith("||") else "|" if body.startswith("|") else ""
        body = body[len(front) :]
        behind = body.endswith("|")
        return front, body[:-1] if behind else body, behind

    @property
    def regex(self) -> str:
        front, body, behind = self._parts
        start = {"||": r"(?:[^/]*\.)?", "|": "", "": "(?s:.*?)"}[front]
        wild = {"*": "(?s:.*?)", "^": r"(?:[^a-z0-9_.%\-]|\Z)"}
        return start + "".join(wild.get(c) or re.escape(c) for c in body) + (r"\Z" if behind else "")

    @property
    def tokens(self) -> tuple[str, ...]:
        # A run is a whole token of the URL if the pattern itself ends it.
        front, body, behind = self._parts
        found = []
        for run in _TOKEN.finditer(body):
            left = bool(front) if run.start() == 0 else body[run.start() - 1] != "*"
            right = behind if run.end() == len(body) else body[run.end()] != "*"
            if left and right:
                found.append(run[0])
        return tuple(dict.fromkeys(found))


# Spam phrases that decide where no site rule does.
DEFAULT_PHRASES = tuple(
    PhraseRule(p)
    for p in (
        "spam-farm cheap-pills online-casino free-viagra adult-cams payday-loans "
        "replica-watches win-prizes free-download-crack link-exchange"
    ).split()
)


def _lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").translate(LOWER_TABLE).decode("utf-8", "surrogatepass")


def _cut_last(name: str) -> str:
    return re.sub(r"[A-Za-z0-9]+\Z", "", name)


def url_parts(df: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """id, host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("id"),
        lower_ascii(F.regexp_extract(url, _PARTS, 1)).alias("host"),
        F.regexp_extract(url, _PARTS, 2).alias("path"),
    )


def token_counts(parts: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """In how many URLs each rule token occurs.  The result has at most one
    row per rule token; partial aggregation absorbs hot tokens."""
    words = F.array_distinct(
        F.regexp_extract_all(lower_ascii(F.concat("host", "path")), F.lit("[a-z0-9]+"), 0)
    )
    mine = F.array_intersect(words, F.array(*[F.lit(t) for t in tokens])) if len(tokens) <= 200 else words
    counted = parts.select(F.explode(mine).alias("token"))
    if len(tokens) > 200:
        listed = parts.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
        counted = counted.join(listed, "token", "left_semi")
    return {r["token"]: r["n"] for r in counted.groupBy("token").agg(F.count("*").alias("n")).collect()}


def build_index(rules: Sequence[SiteRule | PhraseRule | PatternRule], counts: dict[str, int]):
    """token -> rule numbers, and the rules without a whole token."""
    index: dict[str, list[int]] = {}
    always: list[int] = []
    for k, rule in enumerate(rules):
        if rule.tokens:
            rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
            index.setdefault(rarest, []).append(k)
        else:
            always.append(k)
    return index, always


def filter_urls(
    df: DataFrame,
    rules: Sequence[SiteRule],
    phrases: Sequence[PhraseRule | PatternRule] = DEFAULT_PHRASES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Verdict per row: id, host, path, rule, verdict, n_candidates.

    The longest fitting site rule decides (of two as long, a blocking one);
    without one, a URL that a phrase or pattern fits is blocked, unless one
    that fits allows it, and any other is allowed.  Site rules see the path as
    it is, phrases and patterns see A-Z as a-z.  Null URLs and URLs without ``://`` have empty host and path and
    are allowed unless a rule fits the empty text.  Repeated rows and null ids
    are judged like any other row; other columns are ignored.
    """
    parts = url_parts(df, id_col, url_col)
    both = [*rules, *phrases]
    tokens = sorted({t for r in both for t in r.tokens})
    index, always = build_index(both, token_counts(parts, tokens) if tokens else {})
    spec = [(r.regex, getattr(r, "name", None), r.action) for r in both]

    def setup():
        return [(re.compile(regex), name, action) for regex, name, action in spec]

    def judge(batch: pa.RecordBatch, compiled) -> pa.RecordBatch:
        names, verdicts, tried = [], [], []
        for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            whole = host + path
            lowered = _lower(whole)
            ks = set(always)
            for token in set(_TOKEN.findall(lowered)):
                ks.update(index.get(token, ()))
            best, others = None, set()
            for k in ks:
                regex, name, action = compiled[k]
                if regex.match(lowered if name is None else whole):
                    if name is None:
                        others.add(action)
                    else:
                        best = max(best or (0,), (len(name), action == BLOCK, name))
            other = BLOCK if others == {BLOCK} else ALLOW
            names.append(best[2] if best else None)
            verdicts.append((BLOCK if best[1] else ALLOW) if best else other)
            tried.append(len(ks))
        return pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                pa.array(names, pa.string()),
                pa.array(verdicts, pa.string()),
                pa.array(tried, pa.int32()),
            ],
            names=["id", "host", "path", "rule", "verdict", "n_candidates"],
        )

    kind = parts.schema["id"].dataType.simpleString()
    out = arrow_pass(
        parts,
        judge,
        f"id {kind}, host string, path string, rule string, verdict string, n_candidates int",
        setup,
    )
    return out.withColumnRenamed("id", id_col)
