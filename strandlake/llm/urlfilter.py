"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host and a path prefix (it fits the host and all its subdomains) or a wildcard pattern
over the URL. Tokens that every fitting URL must hold whole are its literals; the rarest of them,
counted over all URLs, is the rule's only entry in the index. A pattern's literals are its runs of
word characters that have another character, or a border, on both sides. A URL's tokens fetch candidate
rules, and only those run their regular expressions; rules without a literal are always run.
Of the host rules that fit, the longest wins; without one the longest fitting pattern decides;
without that the URL is allowed.

Rules are taken in blocks of at most ``BLOCK_RULES``. Beyond the first block the URLs are stored with
the longest rule so far and the block's index is destroyed before the next one is broadcast, so one
bounded index is alive at a time. Literals of all rules, which the caller holds as a list,
are counted in one scan for each ``BLOCK_LITERALS`` of them. No shuffle of URLs takes place, whatever tokens
are frequent.

Defined cases: a null URL or one without ``://`` has empty host and path and fits no host rule;
a very long URL is judged whole; repeated rows are judged each; of rules with equal length the
smaller text wins, then block; an empty table gives an empty result, and without rules every URL is
allowed; columns named like a result column give way to it.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import discard, materialize
from .arrow import map_arrow, plus
from .kernel import ALNUM, ALNUM_TRANSLATE, slices, with_columns

BLOCK_RULES = 50_000
#: Literals counted in one scan: about 80 MB as Python objects.
BLOCK_LITERALS = 1_000_000


@dataclass(frozen=True)
class UrlRule:
    """``text`` is like ``example.org/path/`` for a host rule; for a pattern, ``*`` is any run and ``^`` a token's border."""

    text: str
    action: str
    is_pattern: bool = False

    def __post_init__(self):
        if self.action not in ("allow", "block"):
            raise ValueError(f"no such action: {self.action}")
        if not self.is_pattern and "/" not in self.text:
            raise ValueError(f"a host rule needs a path: {self.text}")

    def regex(self) -> bytes:
        """Matched at the start of host and path, or searched in the URL with A-Z lower-cased."""
        text = self.text.encode().lower()  # bytes: A-Z only, as in URLs
        if self.is_pattern:
            border = rb"(?:^|$|[\x00-\x2F\x3A-\x60\x7B-\x7F])"
            return b"".join({b"^": border, b"*": b".*?"}.get(c, re.escape(c)) for c in re.findall(rb".", text, re.DOTALL))
        host, _, path = self.text.partition("/")
        return rb"(?:[^/]*\.)?" + re.escape(host.encode().lower()) + re.escape(b"/" + path.encode())

    def literals(self) -> set[bytes]:
        """Tokens that are whole tokens of every URL that fits."""
        raw = self.text.encode().lower()
        if self.is_pattern:
            runs = re.finditer(rb"(?<=[^*])[^\x00-\x2F\x3A-\x60\x7B-\x7F]+(?=[^*])", raw, re.DOTALL)
            return {m[0] for m in runs if not ALNUM[raw[m.start() - 1]] and not ALNUM[raw[m.end()]]}
        found = raw.translate(ALNUM_TRANSLATE).split()
        if ALNUM[raw[-1]]:  # the last token may go on in the URL
            found = found[:-1]
        return set(found)


def split_url(url: bytes) -> tuple[bytes, bytes]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    _, mark, rest = url.partition(b"://")
    if not mark:
        return b"", b""
    rest = re.split(rb"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition(b"/")
    return host.lower(), slash + path


def token_counts(urls: DataFrame, url_col: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many URLs each literal occurs, over all of them."""
    known = urls.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for url in batch.column("url").cast(pa.large_binary()).to_pylist():
                if url:
                    seen.update(known.value.intersection(url.translate(ALNUM_TRANSLATE).split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema=schema)

    schema = T.StructType([T.StructField("token", T.BinaryType()), T.StructField("n", T.LongType())])
    counted = map_arrow(urls.select(F.col(url_col).alias("url")), count, schema)
    counts = {bytes(t): n for t, n in counted.groupBy("token").agg(F.sum("n")).collect()}  # at most a block's literals
    known.unpersist()
    return counts


def rule_index(rules: list[UrlRule], counts: dict[bytes, int]) -> tuple[dict[bytes, list[int]], list[int]]:
    """Rarest literal -> rules; and the rules without a literal."""
    index: dict[bytes, list[int]] = defaultdict(list)
    always = []
    for i, rule in enumerate(rules):
        literals = rule.literals()
        if literals:
            index[min(literals, key=lambda t: (counts.get(t, 0), t))].append(i)
        else:
            always.append(i)
    return dict(index), always


def filter_urls(pages: DataFrame, rules: list[UrlRule], url_col: str = "url", block_rules: int = BLOCK_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the host rule that decided, else null), ``pattern`` (else the pattern that did) and ``verdict``."""
    text = T.StringType()
    out, stored = pages, None
    fields = [T.StructField(c, text) for c in ("host", "path", "rule", "pattern", "rule_action", "pattern_action")]
    sc = pages.sparkSession.sparkContext
    literals = sorted({t for r in rules for t in r.literals()})
    counts: dict[bytes, int] = {}
    for at in range(0, len(literals), BLOCK_LITERALS):
        counts |= token_counts(pages, url_col, frozenset(literals[at : at + BLOCK_LITERALS]))
    for at in range(0, max(1, len(rules)), block_rules):
        block = rules[at : at + block_rules]
        shared, again = sc.broadcast((block, *rule_index(block, counts))), at > 0

        def judge(batches: Iterator[pa.RecordBatch], schema: pa.Schema, shared=shared, again=again) -> Iterator[pa.RecordBatch]:
            block, index, always = shared.value
            compiled: dict[int, re.Pattern[bytes]] = {}
            better = lambda a: (-len(a[0]), a[0], a[1] != "block")
            for batch in batches:
                for part in slices(batch, url_col):
                    rows = []
                    before = part.select(["rule", "pattern", "rule_action", "pattern_action"]).to_pylist() if again else None
                    for k, url in enumerate(part.column(url_col).cast(pa.large_binary()).to_pylist()):
                        url = url or b""
                        host, path = split_url(url)
                        place, lowered = host + path, url.lower()
                        best: dict[bool, tuple[str, str]] = {}
                        if before:
                            had = before[k]
                            best = {flag: (had[c], had[f"{c}_action"]) for flag, c in ((False, "rule"), (True, "pattern")) if had[c] is not None}
                        candidates = always + [i for t in set(url.translate(ALNUM_TRANSLATE).split()) for i in index.get(t, ())]
                        for i in candidates:
                            rule = block[i]
                            if i not in compiled:
                                compiled[i] = re.compile(rule.regex(), re.DOTALL)
                            if compiled[i].search(lowered) if rule.is_pattern else compiled[i].match(place):
                                mine = (rule.text, rule.action)
                                if rule.is_pattern not in best or better(mine) < better(best[rule.is_pattern]):
                                    best[rule.is_pattern] = mine
                        (rule_text, rule_action), (pattern, pattern_action) = best.get(False, (None, None)), best.get(True, (None, None))
                        rows.append((host.decode("utf-8", "replace"), path.decode("utf-8", "replace"), rule_text, pattern, rule_action, pattern_action))
                    columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * len(fields)
                    yield with_columns(part, {f.name: c for f, c in zip(fields, columns, strict=True)}, schema)

        out = map_arrow(out, judge, plus(pages.schema, *fields))
        if at + block_rules < len(rules):
            before, stored = stored, materialize(out, "judged")
            out = stored
            shared.destroy()
            if before is not None:
                discard(before)
    decided = F.coalesce("rule_action", "pattern_action", F.lit("allow"))
    return out.withColumn("pattern", F.when(F.col("rule").isNull(), F.col("pattern"))).withColumn("verdict", decided).drop("rule_action", "pattern_action")
