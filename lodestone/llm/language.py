"""Language identification by known words, backing off to character n-grams.

A word that stands in any training document scores by its log frequency in each language.
An unseen word is scored by its n-grams, blanks around it included, from the longest
length down: the first length of which any n-gram is known decides. A document's score is
the mean over its words.

Texts are read once: neighbouring documents become a chunk, which keeps where each of its
distinct words stands, and the words themselves with their counts by language. n-grams are
counted from distinct words, weighted by their counts. All that was counted stays; chunks
get the gains of their words by a join, and only unseen words ask for n-grams, a length at
a time, so that no task holds the model. What a language lacks scores a floor that is below
all that was seen. Gains are whole numbers, so that the order of sums does not show.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpointed, fold, quoted, scratch_path
from .hashing import Stretches, distinct, from_planes, mixed, planes

#: what was never seen scores a tenth of this share, or of one occurrence if that is less
MIN_SHARE = 1e-5
LONGEST = 5
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: gains are counted in units of ten to the minus DIGITS
DIGITS = 9
SLICE_CHARS = 1 << 19
#: a chunk ends with the document that fills it
CHUNK_CHARS = 64 << 20
#: words of a chunk that are written at a time
WORD_ROWS = 1 << 15
#: entries of gains added up at a time
STEP = 1 << 18
#: answers that a task packs at a time
PACKED_ROWS = 1 << 19
BLANK = 32

_LETTERS: dict[str, np.ndarray] = {}  # of a worker process


def letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, or a blank."""
    if "map" not in _LETTERS:
        out = np.full(0x110000, BLANK, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                out[c] = ord(low) if len(low := x.lower()) == 1 else c
        _LETTERS["map"] = out
    return _LETTERS["map"]


class Words:
    """The words of some texts: code points with single texts set apart by blanks."""

    def __init__(self, texts: list[str | None]):
        sizes = np.array([len(t or "") + 2 for t in texts], np.int64)
        joined = "".join(f" {t or ''} " for t in texts)
        self.points = letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
        inside = np.zeros(len(self.points) + 1, np.int8)
        inside[:-1] = self.points != BLANK
        step = np.diff(inside, prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.doc = np.searchsorted(np.cumsum(sizes), self.start, side="right")
        self.hash = Stretches(self.points, 4)

    def word_keys(self) -> np.ndarray:
        return mixed(self.hash.of(self.start, self.end))

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of the chosen words with a blank on both sides: their word, their keys."""
        start, end = self.start[which] - 1, self.end[which] + 1
        many = np.maximum(end - start - n + 1, 0)
        owner = np.repeat(np.arange(len(which)), many)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + start[owner]
        return owner, mixed(self.hash.of(at, at + n) + np.uint64(n))


def slices(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[slice]:
    """Neighbouring texts, about ``limit`` characters at a time."""
    low = size = 0
    for k, n in enumerate(pc.utf8_length(texts).to_pylist()):
        size += n or 0
        if size >= limit:
            yield slice(low, k + 1)
            low, size = k + 1, 0
    if low < len(texts):
        yield slice(low, len(texts))


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, their count in front."""
    raw = len(values).to_bytes(8, "little") + planes(values)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, dtype) -> np.ndarray:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return from_planes(raw[8:], dtype)


def gaps(docs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each word's ascending documents as their first and the steps between them, which pack better."""
    out = docs.copy()
    out[1:] -= docs[:-1]
    first = np.cumsum(sizes) - sizes
    out[first] = docs[first]
    return out


def from_gaps(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sizes = sizes.astype(np.int64)
    sums = np.cumsum(steps, dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    return (sums - np.repeat(sums[first] - steps[first], sizes)).astype(np.uint32)


def summed(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and the exact sum of each one's values."""
    order = np.argsort(codes, kind="stable")
    codes, values = codes[order], values[order]
    new = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1)) if len(codes) else np.zeros(0, np.int64)
    return codes[new], np.add.reduceat(values, new) if len(new) else values


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder, compressed more than the default."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Chunk:
    """Documents that are read together: their facts, and the places of their words."""

    def __init__(self) -> None:
        self.ids, self.marks, self.langs, self.many, self.chars = [], [], [], [], 0
        self.keys, self.docs, self.counts = [], [], []
        # keys of the words so far, in order; the same and their letters, as they were found
        self.known, self.found, self.spelled = np.zeros(0, np.uint64), [], []

    def add(self, ids: list, marks: list, langs: list, texts: list) -> None:
        words = Words(texts)
        keys = words.word_keys()
        heads, place = distinct(keys, words.doc.astype(np.uint64))
        own = keys[heads]
        self.keys.append(own)
        self.docs.append((words.doc[heads] + len(self.ids)).astype(np.uint32))
        self.counts.append(np.bincount(place, minlength=len(heads)).astype(np.uint32))
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        at = np.searchsorted(self.known, own[first])
        held = np.append(self.known, np.uint64(0))[at] == own[first]
        held &= at < len(self.known)
        at, first = at[~held], first[~held]
        self.known = np.insert(self.known, at, own[first])
        self.found.append(own[first])
        self.spelled.append(pa.array([
            words.points[s:e].astype("<u4").tobytes().decode("utf-32-le", "replace")
            for s, e in zip(words.start[heads[first]].tolist(), words.end[heads[first]].tolist())], pa.string()))
        self.many += np.bincount(words.doc, minlength=len(texts)).tolist()
        self.ids += ids
        self.marks += marks
        self.langs += langs
        self.chars += sum(len(t or "") for t in texts)

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """One row of the documents, then one of each word, some at a time; the chunk is used up."""
        name = uuid.uuid4().int >> 65

        def taken(parts: list) -> np.ndarray:
            out = np.concatenate(parts)
            parts.clear()
            return out

        keys = taken(self.keys)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        bounds = np.append(first, len(keys))
        sizes = np.diff(bounds)
        del keys
        docs, counts = taken(self.docs)[order], taken(self.counts)[order]
        del order
        yield from self._batch(schema, 1, chunk=[name], ids=[self.ids], marks=[self.marks], many=[self.many],
                               sizes=[packed(sizes.astype(np.uint32))], docs=[packed(gaps(docs, sizes))], counts=[packed(counts)])
        names = sorted({x for x in self.langs if x is not None})
        code = np.array([-1 if x is None else names.index(x) for x in self.langs], np.int64)
        spelled = pa.concat_arrays(self.spelled)
        by_key = np.argsort(taken(self.found))
        for low in range(0, len(first), WORD_ROWS):
            high = min(low + WORD_ROWS, len(first))
            part = slice(bounds[low], bounds[high])
            lang, rank = code[docs[part]], np.repeat(np.arange(high - low), sizes[low:high])
            taught = lang >= 0
            pair, times = summed(rank[taught] * len(names) + lang[taught], counts[part][taught].astype(np.int64))
            ends = np.searchsorted(pair, np.arange(high - low + 1) * len(names)).astype(np.int32)
            labels = pa.DictionaryArray.from_arrays(pa.array(pair % max(len(names), 1), pa.int32()),
                                                    pa.array(names, pa.string())).dictionary_decode()
            yield from self._batch(
                schema, high - low, chunk=np.full(high - low, name), at=np.arange(low, high, dtype=np.int32),
                word=spelled.take(pa.array(by_key[low:high])),
                langs=pa.ListArray.from_arrays(pa.array(ends), labels), times=pa.ListArray.from_arrays(pa.array(ends), pa.array(times)))

    @staticmethod
    def _batch(schema: pa.Schema, n: int, **columns) -> Iterator[pa.RecordBatch]:
        arrays = [pa.nulls(n, f.type) if f.name not in columns else columns[f.name].cast(f.type)
                  if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema]
        if n:
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def read_chunks(docs: DataFrame, id: str, text: str, lang: str) -> DataFrame:
    """All documents as chunks, in one pass, written once so that a chunk's name holds.

    Rows with ``ids`` hold a chunk's documents; the others one word of a chunk each:
    ``at`` (its rank in the chunk), ``word`` and its ``times`` in ``langs`` that are learned from.
    """
    key, content, label = quoted([id, text, lang])
    held = fold(key, FOLDS) == HELD_OUT
    rows = docs.select(key.alias("id"), content.alias("text"), F.coalesce(held, F.lit(False)).alias("mark"),
                       F.when(~F.coalesce(held, F.lit(False)), label.cast("string")).alias("lang"))
    kind = docs.schema[id].dataType
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(to_arrow_type(kind))), ("marks", pa.list_(pa.bool_())),
                        ("many", pa.list_(pa.int64())), ("sizes", pa.binary()), ("docs", pa.binary()),
                        ("counts", pa.binary()), ("at", pa.int32()), ("word", pa.string()),
                        ("langs", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for batch in batches:
            for part in slices(batch.column("text")):
                own = batch.slice(part.start, part.stop - part.start)
                chunk.add(*(own.column(c).to_pylist() for c in ("id", "mark", "lang", "text")))
                if chunk.chars >= CHUNK_CHARS:
                    yield from chunk.rows(schema)
                    chunk = _Chunk()
        if chunk.ids:
            yield from chunk.rows(schema)

    return written(rows.mapInArrow(read, (
        f"chunk bigint, ids array<{kind.simpleString()}>, marks array<boolean>, many array<bigint>, sizes binary, "
        "docs binary, counts binary, at int, word string, langs array<string>, times array<bigint>")), "language-chunks")


def count_grams(words: DataFrame, longest: int) -> DataFrame:
    """Over ``lang, word, times``: ``lang, n, key, times`` of the words' n-grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, int], list] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, n), (keys, times) in kept.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), n, np.int32)),
                     pa.array(keys.view(np.int64)), pa.array(times)], ["lang", "n", "key", "times"])
            kept.clear()

        for batch in batches:
            by: dict[str, list] = {}
            for lang, word, times in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "times"))):
                by.setdefault(lang, []).append((word, times))
            for lang, pairs in by.items():
                words, weight = Words([w for w, _ in pairs]), np.array([t for _, t in pairs], np.int64)
                everything = np.arange(len(words.start))
                for n in range(1, longest + 1):
                    owner, keys = words.grams(everything, n)
                    old = kept.get((lang, n), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                    kept[lang, n] = summed(np.concatenate([old[0], keys]),
                                           np.concatenate([old[1], weight[words.doc[owner]]]))
            if sum(len(k) for k, _ in kept.values()) > 2_000_000:
                yield from emit()
        yield from emit()

    parts = words.select("lang", "word", "times").mapInArrow(count, "lang string, n int, key bigint, times bigint")
    return parts.groupBy("lang", "n", "key").agg(F.sum("times").alias("times"))


def fit(words: DataFrame, min_share: float = MIN_SHARE, longest: int = LONGEST) -> tuple[list[str], DataFrame | None, float]:
    """Languages in order, ``n, key, gains`` for all that was counted, and the floor.

    ``words`` are the ``lang, key, word, times`` learned from; ``n`` is 0 for words.
    ``gains`` has ``place`` (of a language) and ``gain``, its log frequency above the floor.
    Without anything counted there are no languages and no table. The languages' names and
    totals are held by the driver, as they are part of the model.
    """
    # a word of m letters has m + 3 - n n-grams: the totals need no table of counts
    many = [F.sum(F.col("times") * (F.greatest(F.char_length("word") + 3 - n, F.lit(0)) if n else F.lit(1))).alias(str(n))
            for n in range(longest + 1)]
    found = words.groupBy("lang").agg(*many).collect()
    totals = [{"lang": r["lang"], "n": n, "total": r[str(n)]} for r in found for n in range(longest + 1) if r[str(n)]]
    if not totals:
        return [], None, 0.0
    counts = words.select("lang", F.lit(0).alias("n"), "key", "times").unionByName(count_grams(words, longest))
    names = sorted({r["lang"] for r in totals})
    place = {name: k for k, name in enumerate(names)}
    floor = min(np.log10(min_share), -np.log10(max(r["total"] for r in totals))) - 1
    sizes = words.sparkSession.createDataFrame(
        [(r["lang"], r["n"], place[r["lang"]], r["total"]) for r in totals], "lang string, n int, place int, total bigint")
    gain = F.round((F.log10(F.col("times") / F.col("total")) - float(floor)) * 10 ** DIGITS).cast("bigint")
    known = counts.join(F.broadcast(sizes), ["lang", "n"]).groupBy("n", "key") \
        .agg(F.collect_list(F.struct("place", gain.alias("gain"))).alias("gains"))
    return names, written(known, "language-known"), float(floor)


def unseen_gains(unseen: DataFrame, known: DataFrame, longest: int) -> DataFrame:
    """``key, gains`` of words (``key, word``) by the longest n-grams of which any is known.

    Lengths come one at a time: only words without a known n-gram go on to the next.
    """

    def grams_of(n: int):
        def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, own = batch.column("word"), batch.column("key").to_numpy()
                for part in slices(texts):
                    words, keys = Words(texts[part].to_pylist()), own[part]
                    owner, found = words.grams(np.arange(len(words.start)), n)
                    many = np.bincount(owner, minlength=len(words.start))
                    heads, place = distinct(owner.astype(np.uint64), found)
                    owner, times = owner[heads], np.bincount(place, minlength=len(heads))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[words.doc[owner]]), pa.array(found[heads].view(np.int64)), pa.array(times.astype(np.int64)),
                         pa.array(many[owner])], ["word_key", "key", "times", "many"])
        return grams

    done = None
    for n in range(longest, 0, -1):
        asked = unseen.mapInArrow(grams_of(n), "word_key bigint, key bigint, times bigint, many bigint")
        each = asked.join(known.where(F.col("n") == n), "key").select("word_key", "times", "many", F.explode("gains").alias("g")) \
            .groupBy("word_key", "g.place").agg(F.round(F.sum(F.col("g.gain") * F.col("times")) / F.first("many")).cast("bigint").alias("gain"))
        got = checkpointed(each.groupBy(F.col("word_key").alias("key"))
                           .agg(F.collect_list(F.struct("place", "gain")).alias("gains")), "language-backoff")
        done = got if done is None else done.unionByName(got)
        if n > 1:
            unseen = checkpointed(unseen.join(got.select("key"), "key", "left_anti"), "language-unseen")
    return done


def pack_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers ``of, at, place, gain``, one a word, as one row for each chunk of some of them.

    A shuffle of rows and arrays would take several times the room.
    """
    held, size = [], 0

    def emit() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        of, at = rows["of"].to_numpy(), rows["at"].to_numpy()
        order = np.lexsort((at, of))
        rows, of = rows.take(pa.array(order)).combine_chunks(), of[order]
        firsts = np.flatnonzero(np.diff(of, prepend=of[:1] - 1))
        for low, high in zip(firsts, np.append(firsts[1:], len(of))):
            part = rows.slice(low, high - low).combine_chunks()
            many = pc.list_value_length(part["place"]).to_numpy()
            place, gain = (pc.list_flatten(part[c]).to_numpy() for c in ("place", "gain"))
            columns = {"at": part["at"].to_numpy(), "sizes": many, "place": place, "gain": gain}
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(of[low])], pa.int64()), *(pa.array([packed(np.ascontiguousarray(c))], pa.binary()) for c in columns.values())],
                ["of", *columns])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PACKED_ROWS:
            yield from emit()
            held, size = [], 0
    if size:
        yield from emit()


def totals_of(docs: np.ndarray, counts: np.ndarray, sizes: np.ndarray, at: np.ndarray, bounds: np.ndarray,
              place: np.ndarray, gain: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """``document * languages + place`` codes, sorted, and the sum of the gains of each.

    Word ``k`` stands in ``sizes[k]`` of the ``docs``, ``counts`` times each. Word ``at[j]`` has
    the gains from ``bounds[j]`` to ``bounds[j + 1]``.
    """
    answer = np.full(len(sizes), -1, np.int64)
    answer[at] = np.arange(len(at))
    reply = np.repeat(answer, sizes)
    codes, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for low in range(0, len(docs), STEP):
        got = reply[low:low + STEP]
        hit = got >= 0
        got = got[hit]
        n = bounds[got + 1] - bounds[got]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[got], n)
        code = np.repeat(docs[low:low + STEP][hit].astype(np.int64), n) * languages + place[entry]
        value = gain[entry] * np.repeat(counts[low:low + STEP][hit].astype(np.int64), n)
        codes, sums = summed(np.concatenate([codes, code]), np.concatenate([sums, value]))
    return codes, sums


def predict(many: np.ndarray, codes: np.ndarray, sums: np.ndarray, names: list[str]) -> tuple[list[str], np.ndarray]:
    """The best language of each document of ``many`` words, and the share of belief it gets.

    What all languages have in common, the floor, changes neither order nor belief; a
    language without a code has no gain.
    """
    n, size = len(many), len(names)
    if not size:
        return [UNKNOWN] * n, np.zeros(n)
    doc, place = codes // size, codes % size
    mean = np.round(sums / 10.0 ** DIGITS / np.maximum(many, 1)[doc], DIGITS)
    order = np.lexsort((place, -mean, doc))
    first = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
    best, top = np.zeros(n, np.int64), np.zeros(n)
    best[doc[first]], top[doc[first]] = place[first], mean[first]
    weight = np.log(10) * np.minimum(many, 10)
    belief = np.bincount(doc, np.exp((mean - top[doc]) * weight[doc]), n) \
        + (size - np.bincount(doc, minlength=n)) * np.exp(-top * weight)
    return ([names[k] if m else UNKNOWN for k, m in zip(best, many)], np.where(many > 0, 1 / belief, 0.0))


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
             min_share: float = MIN_SHARE, longest: int = LONGEST) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    Learns from the texts and languages of documents whose crc32(id as text) modulo 3
    isn't 1 and whose language isn't null; predicts from the text alone. Null, empty and
    letterless texts are ``und`` with score 0, and so is everything if nothing was
    learned. Ties go to the language that sorts first. Repeated rows count and are
    answered each; an empty table gives no rows; extra columns are not read.
    """
    read = read_chunks(docs, id, text, lang)
    # a word's key follows from the word, so that neither tables nor the shuffle of words hold it
    key = F.xxhash64("word").alias("key")
    spots = read.where("ids is null").select("chunk", "at", "word", "langs", "times")
    # a word that nothing is learned from keeps a row without a language
    words = written(spots.select("word", F.explode_outer(F.arrays_zip("langs", "times")).alias("t"))
                    .groupBy("word", F.col("t.langs").alias("lang"))
                    .agg(F.sum("t.times").alias("times")), "language-words").select(key, "lang", "word", "times")
    taught = words.where("lang is not null")
    names, known, _ = fit(taught, min_share, longest)
    if known is None:
        gains = docs.sparkSession.createDataFrame([], "key bigint, gains array<struct<place int, gain bigint>>")
    else:
        unseen = words.where("lang is null").join(taught.select("key"), "key", "left_anti").select("key", "word")
        gains = known.where("n = 0").select("key", "gains").unionByName(unseen_gains(unseen, known.where("n > 0"), longest))
    answers = spots.select("chunk", "at", key).join(gains, "key") \
        .select(F.col("chunk").alias("of"), "at", F.col("gains.place").alias("place"), F.col("gains.gain").alias("gain")) \
        .mapInArrow(pack_answers, "of bigint, at binary, sizes binary, place binary, gain binary")
    id_type = docs.schema[id].dataType
    arrow_id = to_arrow_type(id_type)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]

        def whole(name: str, dtype) -> np.ndarray:
            return np.concatenate([np.zeros(0, dtype), *(unpacked(x, dtype) for x in right[name].to_pylist())])

        bounds = np.concatenate([[0], np.cumsum(whole("sizes", np.int32), dtype=np.int64)])
        many = np.array(row["many"], np.int64)
        sizes = unpacked(row["sizes"], np.uint32)
        codes, sums = totals_of(from_gaps(unpacked(row["docs"], np.uint32), sizes), unpacked(row["counts"], np.uint32),
                                sizes, whole("at", np.int32), bounds,
                                whole("place", np.int32), whole("gain", np.int64), len(names))
        preds, score = predict(many, codes, sums, names)
        return pa.table({"doc_id": pa.array(row["ids"], arrow_id), "held_out": pa.array(row["marks"], pa.bool_()),
                         "lang_pred": pa.array(preds, pa.string()), "score": pa.array(score)})

    chunks = read.where("ids is not null").select("chunk", "ids", "marks", "many", "sizes", "docs", "counts")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("of")) \
        .applyInArrow(answer, f"doc_id {id_type.simpleString()}, held_out boolean, lang_pred string, score double")
