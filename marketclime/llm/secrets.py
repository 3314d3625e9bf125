"""Secret scans with column functions only: three patterns, and strings of high entropy.

Spans are in code points, end exclusive. Hits of a pattern are cut out with the
built-in regular expressions; their places are running sums over the lengths of
what lies between them. Texts without a hit, nearly all, cost one look per pattern.

Candidate strings are runs of token characters. A candidate belongs to the
first character class that holds all its characters; a window slides over it
and the counts of the character that enters and of the one that leaves change,
as does the sum of c * log2(c). Counts are packed, twelve to a 64-bit number, so
a step changes a few numbers. Each stretch of windows of high Shannon entropy
that overlap or touch is a span, unless the candidate is on the allow list. That
is linear in the candidate's length. Spans gather in short lists that are put
together at the end, so many spans do not cost their square.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns that results must agree on.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs of 20 and more: what AKIA[A-Z0-9]+ finds, shorter ones dropped
HEX = r"[0-9a-f]{24,}"  # likewise
ASSIGN_LEAST = 6

SPAN = "struct<start:int,rank:int,end:int,kind:string>"


@dataclass(frozen=True)
class CharClass:
    """An alphabet, the entropy (bits) from which a window counts, and what a candidate must contain."""

    name: str
    alphabet: str
    bits: float
    needs: tuple[str, ...] = ("[0-9]", "[A-Za-z]")


DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("entropy_hex", DIGITS + "abcdef", 3.0),
    CharClass("entropy_upper", DIGITS + UPPER, 3.4),
    CharClass("entropy_base64", DIGITS + UPPER + LOWER + "+/_-", 3.6),
)
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
SHORT = 256  # spans of a short list
# Candidates that are no secrets: identifiers, placeholders, counting sequences, file and date names.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|redacted|xxxx",
    r"(?i)0123456789|123456789|abcdefgh|qwerty",
    r"^[A-Za-z]++(?:[_/-][A-Za-z]++)*+(?:[_/-]?[0-9]{1,8})?$",  # possessive: a plain repeated group recurses per repetition
    r"^[0-9]{4}-?[0-9]{2}-?[0-9]{2}[A-Za-z0-9_-]{0,12}$",
)


def _gathered(kind: str) -> Column:
    """The empty start of a list that grows by ``_with``."""
    return F.struct(F.array().cast(f"array<{kind}>").alias("few"), F.array().cast(f"array<array<{kind}>>").alias("full"))


def _with(s: Column, item: Column) -> Column:
    """Add ``item``; a short list that is full is put away whole."""
    few = F.concat(s["few"], F.array(item))
    done = F.size(s["few"]) >= SHORT - 1
    return F.struct(
        F.when(done, F.slice(few, 1, 0)).otherwise(few).alias("few"),
        F.when(done, F.concat(s["full"], F.array(few))).otherwise(s["full"]).alias("full"),
    )


def _listed(s: Column) -> Column:
    return F.concat(F.flatten(s["full"]), s["few"])


HIT = "struct<start:int,end:int,string:string>"


def _hits(text: Column, pattern: str) -> Column:
    """Start, end and string of every leftmost non-overlapping match, in order."""
    between = F.split(text, pattern, -1)
    strings = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    first = F.struct(F.lit(0).alias("at"), _gathered(HIT).alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["string"])
        hit = F.struct(start.alias("start"), end.alias("end"), x["string"].alias("string"))
        return F.struct(end.alias("at"), _with(state["out"], hit).alias("out"))

    zipped = F.arrays_zip(F.slice(between, 1, F.size(strings)).alias("gap"), strings.alias("string"))
    found = F.aggregate(zipped, first, step, lambda s: _listed(s["out"]))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{HIT}>"))


def _spans(hits: Column, kind: str, rank: int) -> Column:
    return F.transform(
        hits,
        lambda h: F.struct(h["start"].alias("start"), F.lit(rank).alias("rank"), h["end"].alias("end"), F.lit(kind).alias("kind")),
    )


def base_spans(text: Column) -> list[Column]:
    """Spans of the kinds assign, access and hex, one array each."""
    value = F.regexp_extract
    long_enough = F.filter(_hits(text, ASSIGN), lambda h: F.length(value(h["string"], ASSIGN, 2)) >= ASSIGN_LEAST)
    return [_spans(long_enough, "assign", 0), _spans(_hits(text, ACCESS), "access", 1), _spans(_hits(text, HEX), "hex", 2)]


STRETCH = "struct<first:int,last:int>"
PACKED = 12  # counts in a 64-bit number, five bits each


def _high_stretches(string: Column, chars: CharClass, window: int) -> Column:
    """First and one past the last character (from 0) of each stretch of windows whose entropy reaches ``chars.bits``."""
    if window > 30:
        raise ValueError("counts of a window must fit into five bits")
    fields = [f"c{j}" for j in range(-(-len(chars.alphabet) // PACKED))]
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    # entropy of a window: log2(window) - sum(c * log2(c)) / window
    most = F.lit(window * (math.log2(window) - chars.bits) + 1e-9)
    state = F.struct(
        *[F.lit(0).cast("long").alias(c) for c in fields],
        F.lit(0.0).alias("sum"),
        F.lit(0).alias("end"),
        F.lit(-1).alias("first"),
        F.lit(-1).alias("last"),
        _gathered(STRETCH).alias("out"),
    )

    def placed(code: Column) -> Column:
        """The number that holds a character's count and the bits before it; number -1 for no character."""
        return F.struct(F.floor((code - 1) / PACKED).cast("int").alias("j"), (F.pmod(code - 1, F.lit(PACKED)) * 5).cast("int").alias("r"))

    def count(s: Column, x: Column) -> Column:
        held = F.element_at(F.array(*[s[c] for c in fields]), x["j"] + 1)
        return F.call_function("shiftright", held, x["r"]).bitwiseAND(F.lit(31)).cast("int")

    def part(x: Column, j: int) -> Column:
        return F.when(x["j"] == j, F.call_function("shiftleft", F.lit(1).cast("long"), x["r"])).otherwise(F.lit(0).cast("long"))

    def step(s: Column, x: Column) -> Column:
        come, gone = x["come"], x["gone"]
        leaves = gone["j"] >= 0
        before = F.when(leaves, count(s, gone)).otherwise(1)
        stays = count(s, come) - F.when(leaves & (come["j"] == gone["j"]) & (come["r"] == gone["r"]), 1).otherwise(0)

        def f(n: Column) -> Column:
            return F.element_at(weight, n + 1)

        total = s["sum"] + F.when(leaves, f(before - 1) - f(before)).otherwise(0.0) + f(stays + 1) - f(stays)
        counts = [(s[c] + part(come, j) - F.when(leaves, part(gone, j)).otherwise(F.lit(0).cast("long"))).alias(c) for j, c in enumerate(fields)]
        kept = [s[c].alias(c) for c in ("first", "last", "out")]
        moved = F.struct(*counts, total.alias("sum"), (s["end"] + 1).alias("end"), *kept)
        return F.aggregate(F.array(moved), s, lambda _, m: noted(m))

    def noted(s: Column) -> Column:
        high = (s["end"] >= window) & (s["sum"] <= most)
        closes = high & (s["first"] >= 0) & (s["end"] - window > s["last"])
        opens = high & ((s["first"] < 0) | (s["end"] - window > s["last"]))
        stretch = F.struct(s["first"].alias("first"), s["last"].alias("last"))
        return F.struct(
            *[s[c].alias(c) for c in fields],
            s["sum"].alias("sum"),
            s["end"].alias("end"),
            F.when(opens, s["end"] - window).otherwise(s["first"]).alias("first"),
            F.when(high, s["end"]).otherwise(s["last"]).alias("last"),
            F.when(closes, _with(s["out"], stretch)).otherwise(s["out"]).alias("out"),
        )

    def finish(s: Column) -> Column:
        stretch = F.struct(s["first"].alias("first"), s["last"].alias("last"))
        return F.when(s["first"] >= 0, F.concat(_listed(s["out"]), F.array(stretch))).otherwise(F.array().cast(f"array<{STRETCH}>"))

    codes = F.transform(F.split(string, ""), lambda c: placed(F.position(c, F.lit(chars.alphabet))))

    def steps(come: Column) -> Column:
        gone = F.concat(F.array_repeat(placed(F.lit(0)), window), F.slice(come, 1, F.greatest(F.size(come) - window, F.lit(0))))
        return F.aggregate(F.arrays_zip(come.alias("come"), F.slice(gone, 1, F.size(come)).alias("gone")), state, step, finish)

    return F.flatten(F.transform(F.array(codes), steps))


def entropy_spans(
    text: Column, classes: Sequence[CharClass] = CLASSES, window: int = WINDOW, allow: Sequence[str] = ALLOW
) -> Column:
    """Spans of high entropy in candidate strings that no ``allow`` pattern matches."""

    def allowed(string: Column) -> Column:
        out = F.lit(False)
        for pattern in allow:
            out = out | string.rlike(pattern)
        return out

    def spanned(h: Column, stretches: Column, rank: int, kind: str) -> Column:
        def one(w: Column) -> Column:
            start, end = (h["start"] + w["first"]).alias("start"), (h["start"] + w["last"]).alias("end")
            return F.struct(start, F.lit(rank).alias("rank"), end, F.lit(kind).alias("kind"))

        return F.transform(stretches, one)

    none = F.array().cast(f"array<{SPAN}>")

    def judged(h: Column) -> Column:
        string, out = h["string"], none
        for rank, chars in reversed(list(enumerate(classes, 3))):
            inside = F.translate(string, chars.alphabet, "") == ""
            rich = F.lit(True)
            for need in chars.needs:
                rich = rich & string.rlike(need)
            spans = spanned(h, _high_stretches(string, chars, window), rank, chars.name)
            out = F.when(inside, F.when(rich, spans).otherwise(none)).otherwise(out)
        return out

    kept = F.filter(_hits(text, CANDIDATE), lambda h: ~allowed(h["string"]))
    return F.flatten(F.transform(kept, judged))


def find_secrets(df: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """Add ``into``: all spans as (start, rank, end, kind), by start, then kind as listed.

    Kinds: assign, access, hex, then the entropy classes. Null text counts as
    empty and has no spans. Spans of different kinds may overlap. Rows and other
    columns stay; a column already named ``into`` is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    found = df.drop(into).withColumn(into, F.concat(*base_spans(whole), entropy_spans(whole)))
    return found.withColumn(into, F.sort_array(into))


def redact(df: DataFrame, text: str = "text", secrets: str = "secrets", mask: str = "[SECRET]") -> DataFrame:
    """Replace each maximal run of overlapping spans in ``text`` by ``mask``; texts without spans stay as they are."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.col(text).substr(s["at"] + 1, x["start"] - s["at"])
        inside = x["start"] < s["at"]
        return F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(inside, s["out"]).otherwise(F.concat(s["out"], F.array(gap, F.lit(mask)))).alias("out"),
        )

    def finish(s: Column) -> Column:
        rest = F.col(text).substr(s["at"] + 1, F.length(text) - s["at"])
        return F.concat(F.array_join(s["out"], ""), rest)

    return df.withColumn(text, F.when(F.size(secrets) > 0, F.aggregate(secrets, state, step, finish)).otherwise(F.col(text)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, all spans."""
    found = find_secrets(docs.select("doc_id", "text")).select("doc_id", "secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(F.filter("secrets", lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
