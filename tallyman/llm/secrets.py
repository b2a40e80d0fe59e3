"""Secret scans: fixed patterns, and character Markov models for what they miss.

Base spans come from three patterns (a credential assignment, an access key id,
a hexadecimal run). Further candidates, long runs of key characters, are scored
by two first-order character models, one of random strings and one of ordinary
identifiers: the log-likelihood ratio of the two, averaged over the transitions,
decides. All of it is SQL functions; the models are literal arrays.

The models are trained on the whole corpus, of which only counts of transitions reach the
driver: the values the base patterns found are random, with strings drawn from a hash as
a small prior; the words of all documents, outside all base spans, are ordinary.

Positions count code points, ends are exclusive. A match's position is the
length of everything before it: ``split`` gives the texts between the matches,
``regexp_extract_all`` the matches. Both are folded in blocks, and long runs and
texts are cut into chunks, so that the time stays close to linear in the text's length.

Defined results for edge cases
* null or empty text: counts 0, no spans; null ``doc_id`` is kept;
* candidates that overlap a base span are not added; equal rows give equal results;
* very long texts, runs and lists of spans: as any other, in near-linear time;
* an empty table: no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the task: the base patterns and the least lengths of what they find.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 18
HEX = r"[0-9a-f]+"
HEX_LEAST = 16
#: The kinds in the order that breaks ties between spans with one start.
KINDS = ("assign", "access", "hex", "random")

#: Candidates of the models: runs of this length or more, ended by other characters.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
RUN_LEAST = 20
#: Least average log-likelihood ratio (in nats for each transition) of an added span.
MARGIN = 0.3

#: Training: ordinary words, and the number of hashed strings (32 bytes in base 64;
#: hexadecimal runs are base spans already).
WORD = r"[A-Za-z0-9+/_=-]{4,}"
HASHED = 2000
#: Characters of the models (all of RUN), the count added to every character, and the
#: weight of single characters in a transition's estimate.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SMOOTHING, BACK_OFF = 0.5, 200.0
#: Spans folded at a time, characters of a run scored at a time and of a text redacted at a time.
BLOCK, RUN_CHUNK, TEXT_CHUNK = 512, 256, 1 << 15
#: Log-likelihood ratios are whole multiples of 1 / RATIO_SCALE, so sums are exact.
RATIO_SCALE = 10_000
#: Weight of all hashed strings together, in transitions: one for each pair of characters.
PRIOR = len(ALPHABET) ** 2


_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _running(rows: Column, step: Callable[[Column, Column], Column]) -> Column:
    """A number carried along ``rows`` from 0, after each of them: ``step(at, row)``.

    An array that grows by one is copied each time, so it is put together from blocks."""
    none = F.array().cast("array<int>")

    def place(state: Column, row: Column) -> Column:
        at = step(state["at"], row)
        return F.struct(at.alias("at"), F.concat(state["found"], F.array(at)).alias("found"))

    def block(state: Column, i: Column) -> Column:
        return F.aggregate(F.slice(rows, i * BLOCK + 1, F.lit(BLOCK)), F.struct(state["at"].alias("at"), none.alias("found")), place,
                           lambda s: F.struct(s["at"].alias("at"), F.concat(state["found"], s["found"]).alias("found")))

    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(rows) - 1, F.lit(0)) / BLOCK).cast("int"))
    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("found")), block, lambda s: s["found"])


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, pattern: str, kind: int, least: int, group: int) -> Column:
    """The pattern's non-overlapping matches as structs (start, kind, end, value), where
    ``group`` has at least ``least`` characters; null where nothing matches."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.arrays_zip(between.alias("gap"), F.transform(whole, F.length).alias("n"), values.alias("value"))

    def end(at: Column, row: Column) -> Column:
        return at + row["gap"] + F.coalesce(row["n"], F.lit(0))  # behind the last match there is only a gap

    def span(row: Column, end: Column) -> Column:
        return F.struct((end - row["n"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), row["value"].alias("value"))

    spans = _bound(rows, lambda r: F.zip_with(r, _running(r, end), span))
    return F.filter(spans, lambda s: F.coalesce(F.length(s["value"]), F.lit(0)) >= least)


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind.

    A text is searched for its exact needles first, so that the arrays are only made for
    the few texts that have any. An access key id and a hexadecimal run are maximal runs of
    their characters, so asking for the least length in the pattern finds the same spans
    as dropping the short ones afterwards; an assignment's short values must be matched and dropped."""
    empty = F.array().cast(_SPANS)

    def where(needle: str, spans: Column) -> Column:
        return F.when(text.rlike(needle), spans).otherwise(empty)

    access, hexes = f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", f"[0-9a-f]{{{HEX_LEAST},}}"
    found = F.concat(where("(?i)" + ASSIGN.replace("+)", f"{{{ASSIGN_LEAST},}})"), _spans(text, "(?i)" + ASSIGN, 0, ASSIGN_LEAST, 2)),
                     where(access, _spans(text, access, 1, ACCESS_LEAST, 0)), where(hexes, _spans(text, hexes, 2, HEX_LEAST, 0)))
    return F.array_sort(found)


def rendered(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, in the order of the array."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _transitions(strings: Column, rows: DataFrame) -> dict[tuple[str, str], int]:
    """How often each character follows another in an array of strings: at most one row
    for each pair of the alphabet reaches the driver."""
    two = F.lit("(?s)..")  # the pairs from the first character on and from the second on
    pairs = F.flatten(F.transform(strings, lambda s: F.concat(F.regexp_extract_all(s, two, F.lit(0)), F.regexp_extract_all(F.substr(s, F.lit(2)), two, F.lit(0)))))
    counts = rows.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))
    return {(r.pair[0], r.pair[1]): r.n for r in counts.collect()}


def train(docs: DataFrame, hashed: int = HASHED) -> list[float]:
    """The log-likelihood ratio random : ordinary of each transition, at 128 × the first
    character's code + the second's, from all documents and hashed strings."""
    every_text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    values = F.transform(base_spans(F.col("text")), lambda s: s["value"])
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256)
    drawn = docs.sparkSession.range(hashed).select(F.array(F.translate(F.base64(F.unhex(digest)), "\r\n", "")).alias("s"))
    plain = F.regexp_replace(F.regexp_replace(F.col("text"), "(?i)" + ASSIGN, " "), f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}|[0-9a-f]{{{HEX_LEAST},}}", " ")
    random = every_text.select(values.alias("s"))
    ordinary = every_text.select(F.regexp_extract_all(plain, F.lit(WORD), F.lit(0)).alias("s"))

    def logs(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
        """Transition probabilities, drawn to those of single characters where a context is rare."""
        single = {b: SMOOTHING + sum(counts.get((a, b), 0) for a in ALPHABET) for b in ALPHABET}
        every = sum(single.values())
        out = {}
        for a in ALPHABET:
            n = sum(counts.get((a, b), 0) for b in ALPHABET)
            out |= {(a, b): math.log((counts.get((a, b), 0) + BACK_OFF * single[b] / every) / (n + BACK_OFF)) for b in ALPHABET}
        return out

    found, prior = _transitions(F.col("s"), random), _transitions(F.col("s"), drawn)
    weight = PRIOR / max(1, sum(prior.values()))
    r = logs({k: found.get(k, 0) + weight * prior.get(k, 0) for k in found.keys() | prior.keys()})
    o = logs(_transitions(F.col("s"), ordinary))
    table = [0.0] * (128 * 128)
    for (a, b), v in r.items():
        table[128 * ord(a) + ord(b)] = v - o[a, b]
    return table


def model_spans(text: Column, base: Column, table: list[float], margin: float = MARGIN) -> Column:
    """Runs that no base span touches and the random model explains better by ``margin``.

    Access key ids and hexadecimal runs consist of a run's characters, so a run touches one
    if and only if it holds one. Assignments don't: runs and assignments are walked together,
    by start. The last assignments' end tells whether one reaches into a run; one that
    begins inside it comes next, as runs don't overlap."""
    ratios = F.from_json(F.lit(json.dumps([round(v * RATIO_SCALE) for v in table])), "array<int>")
    chunks = f"(?=(.{{1,{RUN_CHUNK + 1}}})).{{1,{RUN_CHUNK}}}"  # each with the first character of the next one

    def random(value: Column, ratios: Column) -> Column:
        def ratio(chunk: Column, i: Column) -> Column:
            return F.get(ratios, F.ascii(F.substr(chunk, i, F.lit(1))) * 128 + F.ascii(F.substr(chunk, i + 1, F.lit(1))))

        def total(sum_: Column, chunk: Column) -> Column:
            steps = F.sequence(F.lit(1), F.greatest(F.length(chunk) - 1, F.lit(1)))  # a lone last character has no step
            return F.aggregate(steps, sum_, lambda a, i: a + F.when(F.length(chunk) > i, ratio(chunk, i)).otherwise(0).cast("long"))

        every = F.aggregate(F.regexp_extract_all(value, F.lit(chunks), F.lit(1)), F.lit(0).cast("long"), total)
        return every >= margin * RATIO_SCALE * (F.length(value) - 1)

    def reach(far: Column, span: Column) -> Column:
        return F.when(span["kind"] == 0, F.greatest(far, span["end"])).otherwise(far)

    held = f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}|[0-9a-f]{{{HEX_LEAST},}}"
    assigned = F.filter(base, lambda b: b["kind"] == 0)

    def free(row: Column) -> Column:
        inside = F.coalesce((row["after"]["kind"] == 0) & (row["after"]["start"] < row["span"]["end"]), F.lit(False))
        return (row["span"]["kind"] == 3) & (row["span"]["start"] >= row["far"]) & ~inside

    def apart(runs: Column) -> Column:
        walked = _bound(F.array_sort(F.concat(assigned, runs)),
                        lambda b: F.arrays_zip(b.alias("span"), F.slice(b, F.lit(2), F.size(b)).alias("after"), _running(b, reach).alias("far")))
        kept = F.transform(F.filter(walked, lambda r: r["span"].isNotNull() & free(r)), lambda r: r["span"])
        return F.when(F.exists(base, lambda b: b["kind"] == 0), kept).otherwise(runs)

    def chosen(ratios: Column) -> Column:
        return F.filter(_bound(_spans(text, RUN, 3, RUN_LEAST, 0), apart), lambda c: ~c["value"].rlike(held) & random(c["value"], ratios))

    return F.when(text.rlike(RUN), _bound(ratios, chosen)).otherwise(F.array().cast(_SPANS))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", table: list[float] | None = None, margin: float = MARGIN,
         keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, text, base, spans``: the spans of the patterns, and those with the models'
    added; ``row`` holds the input columns named in ``keep``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []))
    table = train(rows.select("doc_id", "text")) if table is None else table
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    return rows.withColumn("spans", F.array_sort(F.concat("base", model_spans(F.col("text"), F.col("base"), table, margin))))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced by ``mark``, a chunk at a time
    (finding a place in a text means counting from its start)."""

    def part(chunk: Column, i: Column) -> Column:
        first = i * TEXT_CHUNK
        mine = F.filter(spans, lambda s: (s["end"] > first) & (s["start"] < first + TEXT_CHUNK))

        def take(state: Column, s: Column) -> Column:
            gap = F.substr(chunk, state["at"] - first + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
            piece = F.when(s["start"] >= state["at"], F.concat(gap, F.lit(mark))).otherwise(F.lit(""))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], F.array(piece)).alias("out"))

        start = F.struct(first.alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(mine, start, take, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(chunk, s["at"] - first + 1, F.lit(TEXT_CHUNK))))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, F.array_join(F.transform(chunks, part), "")).otherwise(text)
