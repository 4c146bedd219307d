"""Substring dedup by line and sentence hashing (operator 10).

A text is cut into lines, and lines into sentences (up to and with the next
``.``, ``!`` or ``?``). Units are compared after normalisation: ASCII letters
in lower case, runs of white space as one blank, none at the ends. Of all
units with the same 128-bit digest anywhere in the corpus, the earliest ranked
one stays, by (doc_id, place in the text); the others are repeats.

* A line of ``min_words`` words or more that is a repeat is cut out together
  with its separator. Blank and very short lines repeat in clean texts and stay.
* A passage may also stand inside lines that differ elsewhere. So sentences are
  compared as well: a run of repeated sentences, one after the other in the
  text, that has ``min_run`` words or more is cut out. Single sentences that
  happen to be common stay. A line of which nothing is left goes as well.

Offsets of what was cut are kept, and refer to the original text.

A unit that occurs again inside a batch of documents is a repeat already
there; only its first occurrence in the batch is compared with others. So a
line that a third of all documents hold costs a row per batch in its group.
Repeats, a small part of all units, are then gathered by document, and texts
are joined to their cuts by digest and id.

Defined results: a null or empty text has no units and stays as it is; a null
doc_id ranks after all others; rows with equal doc_id and equal text are one
occurrence (whatever stays, stays in each of them); an empty table gives no
rows; other columns are passed through or not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_key, text_of

MIN_WORDS = 5
MIN_RUN = 20
SEPARATOR = "\n"
TEXTS = 1000  # of a batch
SENTENCE = re.compile("[^.!?]+[.!?]*|[.!?]+")
LINE = -1  # sentence number of a whole line


def sentences(line: str) -> list[str]:
    """The line in pieces that add up to it."""
    return SENTENCE.findall(line)


def _digest(kind: bytes, words: list[bytes]) -> bytes:
    return hashlib.md5(kind + b" ".join(words), usedforsecurity=False).digest()


def text_units(text: str, separator: str = SEPARATOR) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(line, sentence or LINE, start, end, words, digest) of all units with a word."""
    at = 0
    for i, line in enumerate(text.split(separator)):
        words = line.encode().lower().split()
        if words:
            yield i, LINE, at, at + len(line), len(words), _digest(b"L", words)
            begin = at
            for j, s in enumerate(sentences(line)):
                own = s.encode().lower().split()
                if own:
                    yield i, j, begin, begin + len(s), len(own), _digest(b"S", own)
                begin += len(s)
        at += len(line) + len(separator)


def unit_table(docs: DataFrame, doc_id: str, text: str, min_words: int, separator: str) -> DataFrame:
    """digest, place (last, doc_id, key, line, sentence), words, repeat: the
    units to be compared. ``repeat`` is true for units of which the batch holds
    an earlier one."""
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                # in the order of rank, so that the first of a digest is the earliest; equal rows are one
                order = sorted({(ids[i] is None, ids[i] if ids[i] is not None else 0, keys[i]): i for i in range(len(keys))}.items())
                seen, doc, rows, repeat = set(), [], [], []
                for _, i in order:
                    for unit in text_units(batch.column(2)[i].as_py(), separator):
                        if unit[1] != LINE or unit[4] >= min_words:
                            doc.append(i)
                            rows.append(unit)
                            repeat.append(unit[5] in seen)
                            seen.add(unit[5])
                line, sentence, start, end, words, digest = list(zip(*rows, strict=True)) or [()] * 6
                doc = pa.array(doc, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest, pa.binary()), pa.array(repeat, pa.bool_()), batch.column(1).take(doc), batch.column(0).take(doc),
                     pa.array(line, pa.int32()), pa.array(sentence, pa.int32()), pa.array(start, pa.int32()),
                     pa.array(end, pa.int32()), pa.array(words, pa.int32())],
                    names=["digest", "repeat", "doc_id", "key", "line", "sentence", "start", "end", "words"])

    d = docs.select(text_key(text_of(text)).alias("key"), F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return d.mapInArrow(cut, f"digest binary, repeat boolean, doc_id {kind}, key binary, line int, sentence int, start int, end int, words int")


def repeated_units(units: DataFrame) -> DataFrame:
    """The rows of ``units`` that are not the earliest of their digest."""
    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, first = None, None
        for batch in batches:
            keep = []
            told = [batch.column(c).to_pylist() for c in ("digest", "repeat", "doc_id", "key", "line", "sentence")]
            for i, (d, repeat, *place) in enumerate(zip(*told, strict=True)):
                if repeat:
                    keep.append(i)
                elif d != digest:
                    digest, first = d, place
                elif place != first:
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int32()))

    # known repeats need no company: they are dealt out by their own document
    dealt = units.repartition(F.when(F.col("repeat"), F.col("key")).otherwise(F.col("digest")))
    order = ["repeat", "digest", F.col("doc_id").isNull(), "doc_id", "key", "line", "sentence"]
    return dealt.sortWithinPartitions(*order).mapInArrow(later, units.schema)


def _cut_of(units: list[tuple[int, int, int, int, int]], counts: list[int], min_run: int) -> list[tuple[int, int, int, int]]:
    """What goes, as (line, sentence or LINE, start, end), given a text's repeated
    (line, sentence, start, end, words) in order and how many sentences with a
    word come before each of its lines."""
    lines = [u for u in units if u[1] == LINE]
    gone = {u[0] for u in lines}
    out = [u[:4] for u in lines]
    run: list[tuple] = []

    def close() -> None:
        if sum(u[4] for u in run) >= min_run:
            out.extend(u[:4] for u in run if u[0] not in gone)
        run.clear()

    for u in units:
        if u[1] != LINE:
            if run and counts[u[0]] + u[1] != counts[run[-1][0]] + run[-1][1] + 1:
                close()
            run.append(u)
    close()
    return sorted(out)


def _apply(text: str, units: list[tuple[int, int, int, int, int]], min_run: int, separator: str) -> tuple[str, list[tuple[int, int]]]:
    """(the text that is left, the spans cut out of it)."""
    lines = text.split(separator)
    number, counts, places = 0, [], {}
    for i, line in enumerate(lines):  # number the sentences that have a word
        counts.append(number)
        for j, s in enumerate(sentences(line)):
            if s.encode().split():
                places[i, j] = number
                number += 1
    renumbered = sorted((i, j if j == LINE else places[i, j] - counts[i], a, b, w, j) for i, j, a, b, w in units)
    cut = _cut_of([u[:5] for u in renumbered], counts, min_run)
    original = {(u[0], u[1]): u[5] for u in renumbered}
    gone = {i for i, j, _, _ in cut if j == LINE}
    by_line: dict[int, set[int]] = {}
    for i, j, _, _ in cut:
        if j != LINE:
            by_line.setdefault(i, set()).add(original[i, j])
    kept = []
    for i, line in enumerate(lines):
        if i in gone:
            continue
        if i in by_line:
            line = "".join(s for j, s in enumerate(sentences(line)) if j not in by_line[i]).strip(" \t\r\x0b\x0c")
            if not line:
                continue
        kept.append(line)
    spans: list[tuple[int, int]] = []
    for _, _, a, b in sorted(cut, key=lambda u: u[2]):
        if spans and spans[-1][1] == a:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    return separator.join(kept), spans


def cuts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
         separator: str = SEPARATOR) -> DataFrame:
    """key, doc_id, units: every document's repeated units, in order."""
    repeated = repeated_units(unit_table(docs, doc_id, text, min_words, separator))
    unit = F.struct("line", "sentence", "start", "end", "words")
    return materialize(repeated.groupBy("key", "doc_id").agg(F.array_sort(F.collect_set(unit)).alias("units")), "repeats")


def _rebuilt(docs: DataFrame, repeats: DataFrame, doc_id: str, text: str, min_run: int, separator: str) -> DataFrame:
    """row (all of the input's columns), text (what is left; null stays null), spans, n_units."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    r = repeats.select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"), "units")
    row = row.select("row", text_key(F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit(""))).alias("key"))
    joined = row.join(r, (row["key"] == r["_key"]) & F.col(f"row.`{doc_id}`").eqNullSafe(r["_id"]), "left")
    joined = joined.select("row", F.col(f"row.`{text}`").cast("string").alias("text"), "units")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), []
            for i, units in enumerate(batch.column(2).to_pylist()):
                if units:
                    texts[i], own = _apply(texts[i], [tuple(u.values()) for u in units], min_run, separator)
                    spans.append([{"start": a, "end": b} for a, b in own])
                else:
                    spans.append([])
            n = [t.count(separator) + 1 if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, span), pa.array(n, pa.int64())],
                                             names=["row", "text", "spans", "n_units"])

    added = T.StructType.fromDDL("text string, spans array<struct<start:int,end:int>>, n_units bigint")
    schema = T.StructType([joined.schema["row"], *added.fields])
    return joined.mapInArrow(rebuild, schema)


def dedup_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                 min_run: int = MIN_RUN, separator: str = SEPARATOR) -> DataFrame:
    """Per document: doc_id, n_units (lines), n_removed (code points), removed_spans
    (start and end in the original text, separators not counted), text (what is
    left; null as empty)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = _rebuilt(d, cuts(d, "doc_id", "text", min_words, separator), "doc_id", "text", min_run, separator)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_units", removed.alias("n_removed"),
                        F.col("spans").alias("removed_spans"), F.coalesce("text", F.lit("")).alias("text"))


def deduplicated_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                           min_words: int = MIN_WORDS, min_run: int = MIN_RUN, separator: str = SEPARATOR,
                           length_column: str | None = None) -> DataFrame:
    """``docs`` with repeats cut out of ``text``; all rows and columns stay. A
    column that holds the text's length is set anew where it is cut."""
    found = _rebuilt(docs, cuts(docs, doc_id, text, min_words, separator), doc_id, text, min_run, separator)

    def column(c: str):
        old = F.col(f"row.`{c}`")
        if c == text:
            return F.col("text")
        if c == length_column:
            return F.when(F.size("spans") == 0, old).otherwise(F.length("text")).cast(docs.schema[c].dataType)
        return old

    return found.select(*[column(c).alias(c) for c in docs.columns])
