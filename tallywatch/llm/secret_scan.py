"""Secrets in whole texts: fixed patterns, and sliding-window entropy over candidate strings.

Everything is column expressions. Positions are code points, ends exclusive. The text is split at a
pattern and the lengths of pieces and matches add up to where each match stands.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import text_or_empty

KEYWORDS = "|".join("".join(c if c in "_?" else f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are greedy, so the least length can stand in the pattern; for ASSIGN it can't, a short value uses up its keyword.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

SPAN = "struct<start: bigint, rank: int, end: bigint, kind: string>"


@dataclass(frozen=True)
class CharClass:
    """A character class whose runs are candidates, and the bits a window needs to count as random."""

    kind: str
    alphabet: str
    bits: float
    fold: bool = False

    @property
    def pattern(self) -> str:
        letters = "".join(c for c in self.alphabet if c != "-")
        return "[" + letters + (letters.upper() if self.fold else "") + ("-" if "-" in self.alphabet else "") + "]"


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
CLASSES = (
    CharClass("entropy_b64", UPPER + UPPER.lower() + DIGITS + "+/_=-", 4.0),
    CharClass("entropy_hex", DIGITS + "abcdef", 3.0, fold=True),
    CharClass("entropy_lower36", UPPER.lower() + DIGITS, 3.7),
    CharClass("entropy_upper36", UPPER + DIGITS, 3.7),
)
#: Candidates that are one of these as a whole are no secrets: plain numbers and rulers, identifiers made public.
ALLOW = (
    r"[-_/=+0-9]+",
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
)
#: Strings with one of these in them are placeholders; between marks of its own such a word says nothing about its neighbours.
PLACEHOLDER = "EXAMPLE|example|PLACEHOLDER|placeholder|XXXXXX|xxxxxx"
APART = f"(?:^|[-_/=+])(?:{PLACEHOLDER})(?:[-_/=+]|$)"
#: Parts of words and what joins them; a stretch of which little else is left is made of words, not random.
WORDS = "[A-Z]*[a-z]{2,}|[A-Z]{2,}|[-_/=+]"
LEFT_OF = 16
#: Scale of the whole numbers that stand for c * log2(c): sums by increments are exact and equal to sums from scratch.
SCALE = 1 << 20


def weights(window: int) -> list[int]:
    return [round(c * math.log2(c) * SCALE) if c else 0 for c in range(window + 1)]


def most(window: int, bits: float) -> int:
    """The largest sum of c * log2(c) over a window's counts at which its entropy is still ``bits``."""
    return math.floor(window * (math.log2(window) - bits) * SCALE)


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches; value is a group of the match.

    Appending to an array copies it, so n matches are folded in about sqrt(n) runs of sqrt(n), and the runs then put in a row.
    """
    regex = F.lit(pattern)
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"),
        F.regexp_extract_all(text, regex, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, regex, F.lit(group)).alias("value"),
    )
    spans = "array<struct<start: bigint, end: bigint, value: string>>"
    zero = F.lit(0).cast("long").alias("at")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["piece"])
        end = start + F.length(part["match"])
        found = F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value"))
        last = part["match"].isNull()
        return F.struct(
            F.when(last, start).otherwise(end).alias("at"),
            F.when(last, state["found"]).otherwise(F.concat(state["found"], F.array(found))).alias("found"),
        )

    def append(state: Column, run: Column) -> Column:
        moved = F.transform(
            run["found"], lambda m: F.struct((m["start"] + state["at"]).alias("start"), (m["end"] + state["at"]).alias("end"), m["value"].alias("value"))
        )
        return F.struct((state["at"] + run["at"]).alias("at"), F.concat(state["runs"], F.array(moved)).alias("runs"))

    def fold(pieces: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(pieces))).cast("int")
        numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / size).cast("int"))
        folded = F.transform(
            numbers, lambda i: F.aggregate(F.slice(pieces, i * size + 1, size), F.struct(zero, F.array().cast(spans).alias("found")), step)
        )
        return F.aggregate(folded, F.struct(zero, F.array().cast(f"array<{spans}>").alias("runs")), append, lambda state: F.flatten(state["runs"]))

    # The pieces are a lambda's argument here, so that they are worked out once and not in every run.
    return F.flatten(F.transform(F.array(parts), fold))


def _as_spans(found: Column, rank: int, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def random_windows(candidate: Column, chars: CharClass, window: int) -> Column:
    """array<struct<low, high>>: the unions of windows whose entropy reaches the class's bits.

    One pass over the characters keeps the count of each symbol in the window and the sum of
    c * log2(c); a step changes two counts and adds four weights.
    """
    weight = F.array(*[F.lit(w).cast("long") for w in weights(window)])
    limit = F.lit(most(window, chars.bits)).cast("long")
    letters = F.regexp_extract_all(F.lower(candidate) if chars.fold else candidate, F.lit("."), F.lit(0))
    codes = F.transform(letters, lambda c: F.instr(F.lit(chars.alphabet), c) - 1)
    # Each position meets the symbol that enters and, from the window's width on, the one that leaves (-1: none).
    leaving = F.concat(F.array_repeat(F.lit(-1), window), codes)
    steps = F.arrays_zip(codes.alias("enter"), F.slice(leaving, F.lit(1), F.size(codes)).alias("leave"), F.sequence(F.lit(0), F.size(codes) - 1).alias("at"))

    def step(state: Column, x: Column) -> Column:
        counts, enter, leave = state["counts"], x["enter"], x["leave"]
        gone = F.get(counts, leave)
        there = F.get(counts, enter) - F.when(enter == leave, 1).otherwise(0)
        lost = F.when(leave < 0, F.lit(0).cast("long")).otherwise(F.get(weight, gone) - F.get(weight, gone - 1))
        return F.struct(
            F.transform(counts, lambda n, k: n + F.when(k == enter, 1).otherwise(0) - F.when(k == leave, 1).otherwise(0)).alias("counts"),
            (state["total"] - lost + F.get(weight, there + 1) - F.get(weight, there)).alias("total"),
            state["out"].alias("out"),
        )

    def mark(state: Column, x: Column) -> Column:
        moved, low = step(state, x), x["at"] - (window - 1)
        out = state["out"]
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["low"].alias("low"), (x["at"] + 1).alias("high"))))
        fresh = F.concat(out, F.array(F.struct(low.alias("low"), (x["at"] + 1).alias("high"))))
        joins = (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["high"] >= low)
        return F.struct(
            moved["counts"].alias("counts"),
            moved["total"].alias("total"),
            F.when((low < 0) | (moved["total"] > limit), out).when(joins, joined).otherwise(fresh).alias("out"),
        )

    none = F.array().cast("array<struct<low: int, high: int>>")
    start = F.struct(F.array_repeat(F.lit(0), len(chars.alphabet)).alias("counts"), F.lit(0).cast("long").alias("total"), none.alias("out"))
    return F.aggregate(steps, start, mark, lambda state: state["out"])


def entropy_spans(text: Column, chars: CharClass, rank: int, window: int, allow: tuple[str, ...]) -> Column:
    found = located(text, f"{chars.pattern}{{{window},}}")
    if allow:
        found = F.filter(found, lambda m: ~m["value"].rlike("^(?:" + "|".join(allow) + ")$"))

    def in_run(m: Column) -> Column:
        spans = F.transform(
            random_windows(m["value"], chars, window),
            lambda w: F.struct(
                (m["start"] + w["low"]).alias("start"), F.lit(rank).alias("rank"), (m["start"] + w["high"]).alias("end"), F.lit(chars.kind).alias("kind"),
                F.substr(m["value"], w["low"] + 1, w["high"] - w["low"]).alias("value"),
            ),
        )
        random = F.filter(
            spans,
            lambda x: F.exists(F.split(x["value"], APART, -1), lambda p: (F.length(p) >= window) & ~p.rlike(PLACEHOLDER))
            & (F.length(F.regexp_replace(x["value"], WORDS, "")) * LEFT_OF > F.length(x["value"])),
        )
        return F.transform(random, lambda x: F.struct(x["start"], x["rank"], x["end"], x["kind"]))

    return F.flatten(F.transform(found, in_run)).cast(f"array<{SPAN}>")


def _unless(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(f"array<{SPAN}>")).cast(f"array<{SPAN}>")


def secret_spans(
    docs: DataFrame, window: int = 24, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW,
    names: tuple[str, str] = ("secret_base", "secret_all"),
) -> DataFrame:
    """All columns of ``docs`` and two more, ``names``: arrays of (start, rank, end, kind) by start, then kind, of base spans and of all.

    A null or empty text has empty arrays. Equal rows are scanned each by itself; columns of these
    two names are replaced. Nothing is shuffled, and a text of any length is scanned whole.
    """
    text = text_or_empty()
    strings = "|".join(f"{c.pattern}{{{window}}}" for c in classes)
    assigned = F.filter(located(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= LEAST_VALUE)
    # Each pattern is worked out only for texts in which it occurs at all.
    base = F.concat(
        _unless(text.rlike(f"(?:{KEYWORDS})[\"']?\\x20*[:=]"), _as_spans(assigned, 0, "assign")),
        _unless(text.rlike("AKIA[A-Z0-9]{16}"), _as_spans(located(text, ACCESS), 1, "access")),
        _unless(text.rlike("[0-9a-f]{24}"), _as_spans(located(text, HEX), 2, "hex")),
    )
    found = docs.withColumn(names[0], F.array_sort(base))
    extra = F.concat(*[entropy_spans(text, c, 3 + i, window, allow) for i, c in enumerate(classes)])
    return found.withColumn(names[1], F.array_sort(F.concat(F.col(names[0]), _unless(text.rlike(strings), extra))))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, **options) -> DataFrame:
    """Per row doc_id, counts by kind, the digest of the base spans, and all spans as text (see ``secret_spans``)."""
    base = F.col("secret_base")

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secret_spans(docs.select("doc_id", "text"), **options).select(
        "doc_id",
        *[number(k) for k in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secret_all")).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "<secret>", **options) -> DataFrame:
    """The same rows and columns with every span, overlapping ones as one, replaced by ``mask``; a null text stays null."""
    taken = {c.lower() for c in docs.columns}
    tail = next(t for t in ("_" * n for n in range(len(taken) + 1)) if not taken & {f"secret_base{t}", f"secret_all{t}"})
    names = (f"secret_base{tail}", f"secret_all{tail}")
    spans, text = F.col(names[1]), F.col("text")

    def step(state: Column, span: Column) -> Column:
        piece = F.when(span["start"] < state["at"], F.lit("")).otherwise(
            F.concat(F.substring(text, state["at"].cast("int") + 1, (span["start"] - state["at"]).cast("int")), F.lit(mask))
        )
        return F.struct(F.concat(state["out"], piece).alias("out"), F.greatest(state["at"], span["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    masked = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"].cast("int") + 1)))
    found = secret_spans(docs, names=names, **options)
    return found.withColumn("text", F.when(F.size(spans) > 0, masked).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle_sql(window: int = 24) -> str:
    """The same over ``documents`` in SQL, windows counted from scratch."""

    def found(kind: str, rank: int, pattern: str, group: int = 0, test: str = "true") -> str:
        quoted = pattern.replace("'", "''")
        return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, vs[i] AS value,
            CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start, length(ms[i]) AS size
          FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{quoted}') AS ps,
            regexp_extract_all(t, '{quoted}', 0) AS ms, regexp_extract_all(t, '{quoted}', {group}) AS vs FROM d)) WHERE {test}"""

    allowed = "|".join(ALLOW).replace("'", "''")
    kinds = " UNION ALL ".join(found(c.kind, 3 + i, f"{c.pattern}{{{window},}}") for i, c in enumerate(CLASSES))
    limits = "CASE kind " + " ".join(f"WHEN '{c.kind}' THEN {most(window, c.bits)}" for c in CLASSES) + " END"
    folds = " OR ".join(f"kind = '{c.kind}'" for c in CLASSES if c.fold) or "false"
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    base AS ({found("assign", 0, ASSIGN, 2, f"length(vs[i]) >= {LEAST_VALUE}")} UNION ALL {found("access", 1, ACCESS)} UNION ALL {found("hex", 2, HEX)}),
    cand AS (SELECT *, row_number() OVER () AS c FROM ({kinds}) WHERE NOT regexp_full_match(value, '{allowed}')),
    win AS (SELECT c, unnest(range(0, size - {window} + 1)) AS w FROM cand),
    ent AS (SELECT c, w, sum({weights(window)}[n + 1]) AS total FROM (
        SELECT c, w, ch, count(*) AS n FROM (SELECT c, w, unnest(string_split(substr(CASE WHEN {folds} THEN lower(value) ELSE value END, w + 1, {window}), '')) AS ch FROM win JOIN cand USING (c))
        GROUP BY c, w, ch) GROUP BY c, w),
    hit AS (SELECT c, w, kind, rank, doc_id, start FROM ent JOIN cand USING (c) WHERE total <= {limits}),
    runs AS (SELECT *, sum(CASE WHEN w > prev + {window} OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY w) AS island
            FROM (SELECT *, lag(w) OVER (PARTITION BY c ORDER BY w) AS prev FROM hit)),
    isl AS (SELECT r.c, any_value(r.kind) AS kind, any_value(r.rank) AS rank, any_value(r.doc_id) AS doc_id, any_value(r.start) AS start, min(w) AS low, max(w) + {window} AS high,
            substr(any_value(value), min(w) + 1, max(w) + {window} - min(w)) AS v FROM runs r JOIN cand k ON r.c = k.c GROUP BY r.c, island),
    spans AS (SELECT doc_id, kind, rank, start, start + size AS stop FROM base
              UNION ALL SELECT doc_id, kind, rank, start + low, start + high FROM isl
              WHERE len(list_filter(string_split_regex(v, '{APART}'), lambda p: length(p) >= {window} AND NOT regexp_matches(p, '{PLACEHOLDER}'))) > 0 AND length(regexp_replace(v, '{WORDS}', '', 'g')) * {LEFT_OF} > length(v)),
    texts AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN texts USING (doc_id)"""
