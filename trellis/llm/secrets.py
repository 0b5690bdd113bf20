r"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's regex a Boolean query over trigrams is derived, as in regular-expression search with a trigram index
(Cox, 2012): `trigrams.query` parses the regex and gives alternatives, each a set of trigrams that a text must hold, compared in
lower case, so that it never misses. A rule without a mandatory trigram has no query and is run on every text.

`postings` gives the trigrams that some rule asks for as a table (trigram, document), the index, and `candidates` intersects
that by one aggregation over documents, for an index that is kept. As all postings of a document come from its own row, `scan` intersects them
there, rarest first and only as far as they go on holding, before anything moves: no text is shuffled. Candidates are then matched by the regex itself.

Offsets are code points, end exclusive. Matches of a rule are leftmost and do not overlap; those that are too
short are dropped after matching, so they still use up their text, as the rules state. `hex` is a run of 16 or more
hexadecimal digits, and `access` may state its length in the regex: a run that is too short can hold no longer match.

Null and empty texts have no spans. Repeated rows are judged each for itself. Columns
named like the results are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trigrams
from .common import text_column


@dataclass(frozen=True)
class SecretRule:
    """A kind, its Java regex, and the length that a group must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    def queries(self) -> list[list[str]]:
        """Alternatives, each the trigrams that must all be there; empty: scan all texts."""
        return trigrams.query(self.pattern)


#: The base kinds in their order, then formats of tokens that their issuers publish.
RULES = (
    SecretRule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    SecretRule("access", r"AKIA[A-Z0-9]{14,}"),
    SecretRule("hex", r"[0-9a-f]{16,}"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    SecretRule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
ADDED = ["spans", "n_assign", "n_access", "n_hex"]


#: Bits in a word of postings.
WORD = 63


def _wanted(rules: tuple[SecretRule, ...]) -> list[str]:
    return sorted({t for r in rules for q in r.queries() for t in q})


def postings(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, *, text_col: str = "text", key_col: str = "_key") -> DataFrame:
    """The index: trigram and document, for the trigrams that the rules ask for."""
    rows = docs.select(F.col(key_col), F.lower(text_column(docs, text_col)).alias("_low"))
    found = F.filter(F.array(*(F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in _wanted(rules))), lambda t: t.isNotNull())
    return rows.select(F.col(key_col), F.explode(found).alias("trigram"))


def _words(found: Column, wanted: list[str]) -> list[Column]:
    """An array of trigrams as words of bits."""
    zero = F.lit(0).cast("long")

    def word(part: list[str]) -> Column:
        bit = F.create_map(*(x for i, t in enumerate(part) for x in (F.lit(t), F.lit(1 << i).cast("long"))))
        return F.aggregate(found, zero, lambda a, t: a.bitwiseOR(F.coalesce(bit[t], zero)))

    return [word(wanted[w : w + WORD]) for w in range(0, len(wanted), WORD)]


def _kinds(rules: tuple[SecretRule, ...], holds: Callable[[list[str]], Column]) -> Column:
    """The kinds of which some alternative holds."""
    kinds = []
    for r in rules:
        if queries := r.queries():
            some = holds(queries[0])
            for q in queries[1:]:
                some = some | holds(q)
            kinds.append(F.when(some, F.lit(r.kind)))
    return F.filter(F.array(*kinds), lambda k: k.isNotNull()) if kinds else F.array().cast("array<string>")


def candidates(index: DataFrame, rules: tuple[SecretRule, ...] = RULES, *, key_col: str = "_key") -> DataFrame:
    """Documents of a kept index with the kinds whose queries their postings satisfy. Postings become bits, and meet in one OR by document."""
    wanted = _wanted(rules)
    words = [F.bit_or(w).alias(f"_bits{i}") for i, w in enumerate(_words(F.array("trigram"), wanted))]
    met = index.groupBy(key_col).agg(*words) if words else index.select(key_col).distinct()
    place = {t: divmod(i, WORD) for i, t in enumerate(wanted)}

    def holds(query: list[str]) -> Column:
        out = F.lit(True)
        for w in range(len(words)):
            if mask := sum(1 << place[t][1] for t in query if place[t][0] == w):
                out = out & (F.col(f"_bits{w}").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
        return out

    found = _kinds(rules, holds)
    return met.select(key_col, found.alias("_kinds")).where(F.size("_kinds") > 0)


def spans_of(text: Column, rule: SecretRule, order: int) -> Column:
    """All matches of one rule as structs: the texts between matches give the offsets of what lies between them."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    parts = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, m: F.struct(F.char_length(g).alias("g"), F.char_length(m).alias("m")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("done"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["g"]
        end = begin + p["m"]
        return F.struct(end.alias("at"), F.concat(acc["done"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("done"))

    placed = F.aggregate(parts, start, step, lambda acc: acc["done"])
    if rule.least:
        value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
        placed = F.transform(F.filter(F.arrays_zip(placed.alias("s"), value.alias("v")), lambda z: F.char_length(z["v"]) >= rule.least), lambda z: z["s"])
    # a text without a match, as nearly all are, is looked at once only
    placed = F.when(F.rlike(text, F.lit(rule.pattern)), placed).otherwise(none)
    return F.transform(placed, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))


def scan(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with `spans`: structs (start, order, end, kind) in that order."""
    docs = docs.drop(*ADDED)
    return _scanned(docs, rules, text_col).select("_doc.*", "spans")


def _scanned(docs: DataFrame, rules: tuple[SecretRule, ...], text_col: str) -> DataFrame:
    """`_doc`, the whole row, and `spans`. Each step is a column of its own: postings, their bits, kinds, spans."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"), text_column(docs, text_col).alias("_text"))

    def holds(query: list[str]) -> Column:
        first, *rest = trigrams.rarest_first(query)
        out = F.contains("_low", F.lit(first))
        for t in rest:
            out = out & F.contains("_low", F.lit(t))
        return out

    rows = rows.withColumn("_low", F.lower("_text")).select("_doc", "_text", _kinds(rules, holds).alias("_kinds"))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    spans = []
    for order, rule in enumerate(rules):
        here = spans_of(F.col("_text"), rule, order)
        spans.append(F.when(F.array_contains("_kinds", rule.kind), here).otherwise(none) if rule.queries() else here)
    return rows.select("_doc", F.array_sort(F.concat(*spans)).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, *, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all their columns as they are, with every span replaced by a mark (overlapping spans by one); null texts stay null, and
    n_chars, where it is a column, is counted anew for texts that change."""
    found = _scanned(docs, rules, text_col)
    text = F.col("_doc")[text_col].cast("string")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        piece = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        done = F.when(inside, acc["done"]).otherwise(F.concat(acc["done"], piece, F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), done.alias("done"))

    rest = F.aggregate("spans", start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    changed = F.size("spans") > 0
    out = found.select("_doc", F.when(changed, rest).otherwise(text).alias("_new"), changed.alias("_changed"))
    old = lambda c: F.col("_doc")[c]
    columns = [F.col("_new").alias(c) if c == text_col else F.when(F.col("_changed"), F.char_length("_new").cast(t)).otherwise(old(c)).alias(c) if c == "n_chars" else old(c).alias(c) for c, t in docs.dtypes]
    return out.select(*columns)
