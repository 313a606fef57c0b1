"""Ingest of MEI score documents.

Python walks one XML document and flattens it into rows, in document order. What only the walk knows for free goes
along: an event's number in its part, how long it lasts, where it and its measure begin, and the notes before it where
a tie asks for them. What the rows mean otherwise (pitches, ties, header fields) is worked out by Spark.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import math
import re
import sys
import xml.etree.ElementTree as ET
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteloom.functions import pitch
from noteloom.operators.notes import PART, merge_ties
from noteloom.operators.ordered import BLOCK_ROWS
from noteloom.operators.repeats import ending_numbers
from noteloom.sources.tables import store

# The flattening travels with the job, so that workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Containers whose children stand in a layer's time line, the
# elements that take time, the ppq of a score that states none, and the note
# values with names, in whole notes.
CONTAINERS = {"beam", "tuplet", "bTrem", "fTrem"}
TIMED = {"note", "chord", "rest", "mRest", "space", "mSpace"}
DEFAULT_PPQ = 480
NAMED_DURATIONS = {"breve": 2, "long": 4, "maxima": 8}

# Ways to give an event its length: what is written fills in for unstated ticks, or only what is encoded counts.
TIMINGS = ("written", "encoded")
_WHOLE = re.compile(r"[+-]?[0-9]{1,18}")
_DECIMAL = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")

# Rows of finished documents are handed on once there are this many.
BATCH_ROWS = 4_000

ELEMENTS = (
    "piece_id string, kind string, pos bigint, tag string, measure_seq bigint, section_seq bigint,"
    " ending_seq bigint, after_other boolean, staff string, layer string, part int, ppq int, piece_ppq int,"
    " meter_count int, meter_unit int, num int, numbase int, attrs map<string,string>, text string,"
    " notes array<map<string,string>>, seq bigint, "
    + ", ".join(f"{timing} struct<ticks:bigint,start:bigint,earlier:bigint>" for timing in TIMINGS)
    # Of an event: whether another section began, the notes of the event before it in its part if its own are tied,
    # and whether any event of its part has such notes. What is stated of a single note stands in its notes alone.
    + ", section_start boolean, notes_before array<map<string,string>>, part_tied boolean"
)
_strings = pa.map_(pa.string(), pa.string())
_spans = pa.struct([("ticks", pa.int64()), ("start", pa.int64()), ("earlier", pa.int64())])
_ARROW = pa.schema(
    [
        ("piece_id", pa.string()), ("kind", pa.string()), ("pos", pa.int64()), ("tag", pa.string()),
        ("measure_seq", pa.int64()), ("section_seq", pa.int64()), ("ending_seq", pa.int64()),
        ("after_other", pa.bool_()), ("staff", pa.string()), ("layer", pa.string()), ("part", pa.int32()),
        ("ppq", pa.int32()), ("piece_ppq", pa.int32()), ("meter_count", pa.int32()), ("meter_unit", pa.int32()),
        ("num", pa.int32()), ("numbase", pa.int32()), ("attrs", _strings), ("text", pa.string()),
        ("notes", pa.list_(_strings)), ("seq", pa.int64()), *[(timing, _spans) for timing in TIMINGS],
        ("section_start", pa.bool_()), ("notes_before", pa.list_(_strings)), ("part_tied", pa.bool_()),
    ]
)
_KINDS = dict(zip(_ARROW.names, _ARROW.types))
_GAP = (None,) * len(_ARROW)  # a row without values


class _Names(dict):
    """Names without their namespace, by the names as they are read; so many are kept as any real corpus has."""

    def __missing__(self, name: str) -> str:
        short = name.rsplit("}", 1)[-1]
        if len(self) < 1 << 16:
            self[name] = short
        return short


class _Lengths(dict):
    """Ticks of events by all they depend on, as written and as encoded; as many are kept as of names."""

    def __missing__(self, key: tuple) -> tuple[int, ...]:
        *event, whole = key
        found = tuple(int((length or 0) * whole / event[5]) for length in _lengths(*event))
        if len(self) < 1 << 16:
            self[key] = found
        return found


class _Shapes(dict):
    """Of names of attributes: whether those that tell a length stand without namespace, and whether a tie is among them."""

    def __missing__(self, names: tuple[str, ...]) -> tuple[bool, bool]:
        short = [_LOCAL[name] for name in names]
        plain = not any(name in _TIMES and name != whole for name, whole in zip(short, names))
        found = plain, "tie" in short or "tied" in short
        if len(self) < 1 << 16:
            self[names] = found
        return found


_LOCAL = _Names()
_KNOWN = _Lengths()
_SHAPES = _Shapes()
_TIMES = frozenset({"dur.ppq", "dur", "dots", "grace"})

# What the walk must know of a document before it begins, and what changes its state.
_AHEAD = frozenset({"scoreDef", "staffDef", "tie", "fermata", "ending"})
_STATE = frozenset({"scoreDef", "staffDef", "meterSig", "section", "ending", "measure"})
_NO_RATIO = (None, None)


def _name(element: ET.Element) -> str:
    return _LOCAL[element.tag]


def _number(value: str | None) -> int | None:
    """A non-negative whole number that fits a column, else nothing."""
    if not value or not value.isascii() or not value.isdecimal() or len(value) > 10:
        return None
    number = int(value)
    return number if number < 1 << 31 else None


def _ticks(dur: str, dots: str, ppq: int, num: int | None, numbase: int | None) -> int | None:
    """Ticks of a written note value; nothing if nobody knows it."""
    wholes: float | None = NAMED_DURATIONS.get(dur)
    if wholes is None and _DECIMAL.fullmatch(dur) and float(dur):
        wholes = 1 / float(dur)
    if wholes is None:
        return None
    stretch = 2 - 0.5 ** (int(dots) if _WHOLE.fullmatch(dots) and len(dots) < 4 else 0)
    ticks = ppq * 4 * wholes * stretch * (numbase / num if num and numbase is not None else 1.0)
    return math.floor(ticks + 0.5) if abs(ticks) < 1 << 53 else None


def _lengths(
    tag: str, stated: str | None, dur: str | None, dots: str | None, grace: bool, ppq: int,
    ratio: tuple[int | None, int | None], metre: tuple[int | None, int | None],
) -> tuple[int | None, int | None]:
    """Length of an event in its staff's ticks, as written and as encoded; nothing where it has none."""
    text = (stated or "").strip()
    if text and _WHOLE.fullmatch(text):
        return int(text), int(text)
    if tag in ("mRest", "mSpace"):
        return _metric(ppq, metre), ppq * 4
    if grace:
        return None, None
    return _ticks((dur or "").strip(), (dots or "").strip(), ppq, *ratio), None


def _metric(ppq: int, metre: tuple[int | None, int | None]) -> int:
    """Ticks of a measure of the metre in force, or of four quarters."""
    count, unit = metre
    return ppq * 4 * count // unit if count and unit else ppq * 4


def _note(element: ET.Element, tied: set[str], held: set[str]) -> dict[str, str]:
    """What is stated of a note: its own attributes, those of its accidentals, and marks set elsewhere."""
    fields = element.attrib
    if len(element):
        more = {}
        for child in element:
            if _LOCAL[child.tag] == "accid":
                for key, value in child.items():
                    more.setdefault(f"child.{_LOCAL[key]}", value)
        if more:
            fields = fields | more
    if tied or held:
        ids = {value for key, value in fields.items() if _LOCAL[key] == "id"}
        if ids & tied:
            fields = {**fields, "tied": fields.get("tied", "1")}
        if ids & held:
            fields = {**fields, "held": fields.get("held", "1")}
    return fields


def flatten_document(content: bytes, piece_id: str) -> list[tuple | list]:
    """Rows of one document, as wide as ``ELEMENTS``: its state, header, measures and layer events.

    Whatever is wrong with a document stays with it: it gives one row with the reason.
    """
    error, rows = None, []
    try:
        root = ET.fromstring(content)
        if _name(root) == "mei":
            rows = _rows(root, piece_id)
        else:
            error = f"not a score: its root element is <{_name(root)}>, not <mei>"
    except ET.ParseError as problem:
        error = f"not well-formed XML: {problem}"
    except (ValueError, TypeError, LookupError, RecursionError) as problem:
        error, rows = f"unreadable: {type(problem).__name__}: {problem}", []
    digest = hashlib.sha256(content or b"").hexdigest()
    return [(piece_id, "score", 0, digest, *_GAP[4:18], error, *_GAP[19:]), *rows]


def _rows(root: ET.Element, piece_id: str) -> list[tuple | list]:
    rows: list[tuple | list] = []
    local, known, shapes = _LOCAL, _KNOWN, _SHAPES
    score_ppq: list[int | None] = []
    stated: list[ET.Element] = []
    tied: set[str] = set()
    held: set[str] = set()
    has_endings = False
    for element in root.iter():
        tag = local[element.tag]
        if tag not in _AHEAD:
            continue
        if tag == "scoreDef":
            score_ppq.append(_number(element.get("ppq")))
        elif tag == "staffDef":
            stated.append(element)
        elif tag == "tie":
            tied.add(element.get("endid", "").lstrip("#"))
        elif tag == "fermata":
            held.add(element.get("startid", "").lstrip("#"))
        else:
            has_endings = True
    default = (score_ppq[0] if score_ppq else None) or DEFAULT_PPQ
    staff_ppq = {e.get("n"): _number(e.get("ppq")) or default for e in stated}
    whole = max([default if not staff_ppq else 0, *staff_ppq.values()])
    metre: tuple[int | None, int | None] = _NO_RATIO
    parts: dict[tuple[str, str], int] = {}
    # Of each part: its events so far, and the section and the notes of the last of them.
    heard: dict[int, tuple[int, int | None, list]] = {}
    chained: set[int] = set()  # parts with notes that are tied to the event before
    starts = [0] * len(TIMINGS)  # where the next measure begins, by each timing
    pos = measure_seq = section_seq = ending_seq = 0

    def events(layer: ET.Element, place: tuple, shown: str, filled: list[int]) -> None:
        nonlocal pos
        section, part, ppq = place[1], place[6], place[7]
        todo = [(iter(layer), _NO_RATIO)]
        while todo:
            children, ratio = todo.pop()
            for element in children:
                tag = local[element.tag]
                if tag in CONTAINERS:
                    # The rest of these children comes after those of the container.
                    todo.append((children, ratio))
                    if tag == "tuplet":
                        ratio = (_number(element.get("num")), _number(element.get("numbase")))
                    todo.append((iter(element), ratio))
                    break
                if tag not in TIMED:
                    continue
                pos += 1
                fields = element.attrib
                plain, joins = shapes[tuple(fields)]
                if plain:
                    get = fields.get
                else:  # the first of equal names counts
                    get = {local[key]: value for key, value in reversed(fields.items())}.get
                if tag == "note":
                    notes, fields = [_note(element, tied, held)], None  # told once
                else:
                    notes = [_note(c, tied, held) for c in element if local[c.tag] == "note"]
                ticks = known[
                    tag, get("dur.ppq"), get("dur"), get("dots"), get("grace") is not None, ppq, ratio, metre, whole
                ]
                times = zip(ticks, starts, filled)
                seq, section_before, before = heard.get(part, (0, None, None))
                seq += 1
                heard[part] = (seq, section, notes)
                if before and (joins if tag == "note" and not tied else any(shapes[tuple(n)][1] for n in notes)):
                    chained.add(part)
                else:
                    before = None
                rows.append([
                    piece_id, "event", pos, tag, *place, *ratio, fields, shown, notes, seq, *times,
                    section is None or section != section_before, before, False,
                ])
                for i, more in enumerate(ticks):
                    filled[i] += more

    def measure(element: ET.Element, place: tuple) -> None:
        *place, ending = place
        here, at, shown = (measure_seq, *place), pos, element.get("n", "0")
        filled: dict[int, list[int]] = {}  # ticks of each part in this measure
        for staff in element:
            if local[staff.tag] != "staff":
                continue
            n = staff.get("n", "")
            for layer in staff:
                if local[layer.tag] != "layer":
                    continue
                voice = (n, layer.get("n", "1"))
                part = parts.setdefault(voice, len(parts) + 1)
                if part not in filled:
                    filled[part] = [0] * len(TIMINGS)
                events(layer, (*here, *voice, part, staff_ppq.get(n, default), whole, *metre), shown, filled[part])
        # As long as its longest voice; one that no voice fills has the length of the metre.
        times = []
        for i in range(len(TIMINGS)):
            longest = max([ticks[i] for ticks in filled.values()], default=0)
            length = longest if longest > 0 else _metric(whole, metre)
            times.append((length, starts[i], 0))
            starts[i] += length
        named = element.attrib
        if ending is not None:
            named = named.copy()
            for key, value in ending.items():
                named.setdefault(f"ending.{local[key]}", value)
        rows.append((
            piece_id, "measure", at, None, *here, None, None, None, None, whole, *metre, None, None,
            named, None, None, None, *times, None, None, None,
        ))

    # Elements still to visit, whether they stand in the header, the two tags above them, and their place: section,
    # ending, whether something other than a measure or an ending stands before the ending, and its element.
    todo: list[tuple[ET.Element, bool, str, str, tuple]] = [(root, False, "", "", (None,) * 4)]
    gap_8, gap_4, gap_7 = _GAP[4:12], _GAP[13:17], _GAP[19:]
    while todo:
        element, in_head, above, parent, place = todo.pop()
        tag = local[element.tag]
        pos += 1
        if in_head:
            rows.append((
                piece_id, "head", pos, f"{above}/{parent}/{tag}", *gap_8, whole, *gap_4, element.attrib,
                (element.text or "").strip(), *gap_7,
            ))
        if tag in _STATE:
            if tag == "measure":
                measure_seq += 1
                measure(element, place)
                continue
            if tag == "section":
                section_seq += 1
                place = (section_seq, None, *place[2:])
            elif tag == "ending":
                ending_seq += 1
                place = (place[0], ending_seq, place[2], element)
            else:
                prefix = "" if tag == "meterSig" else "meter."
                stated_metre = (_number(element.get(f"{prefix}count")), _number(element.get(f"{prefix}unit")))
                if all(stated_metre):
                    metre = stated_metre
        if len(element):
            in_head = in_head or tag == "meiHead"
            if not has_endings:
                todo += [(child, in_head, parent, tag, place) for child in reversed(element)]
                continue
            before, children = "", []
            for child in element:
                name = local[child.tag]
                if name == "ending":
                    stands = (*place[:2], before not in ("measure", "ending"), place[3])
                    children.append((child, in_head, parent, tag, stands))
                else:
                    children.append((child, in_head, parent, tag, place))
                before = name or before
            children.reverse()
            todo += children
    if chained:
        for row in rows:
            if row[1] == "event" and row[10] in chained:
                row[-1] = True
    return rows


def _offsets(lists: Sequence) -> pa.Array:
    """Where each list or dictionary begins among the items of all; a missing one begins nowhere."""
    ends = np.zeros(len(lists) + 1, np.int32)
    missing = None
    try:
        sizes = list(map(len, lists))
    except TypeError:
        sizes = [0 if x is None else len(x) for x in lists]
        missing = np.array([x is None for x in lists] + [False])
    np.cumsum(sizes, out=ends[1:])
    return pa.array(ends, mask=missing)


def _maps(named: Sequence) -> pa.Array:
    """Attributes by their names without namespace."""
    given = list(filter(None, named))
    keys = list(map(_LOCAL.__getitem__, itertools.chain.from_iterable(given)))
    values = list(itertools.chain.from_iterable(map(dict.values, given)))
    return pa.MapArray.from_arrays(_offsets(named), pa.array(keys, pa.string()), pa.array(values, pa.string()))


def _column(name: str, values: tuple) -> pa.Array:
    kind = _KINDS[name]
    if values[0] is None and values.count(None) == len(values):
        return pa.nulls(len(values), kind)
    if name == "attrs":
        return _maps(values)
    if kind == _KINDS["notes"]:
        return pa.ListArray.from_arrays(_offsets(values), _maps([note for x in values if x for note in x]))
    if name in TIMINGS:
        missing = None if all(values) else pa.array([x is None for x in values])
        fields = zip(*(values if missing is None else [x or (None, None, None) for x in values]))
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], fields=list(kind), mask=missing)
    return pa.array(values, kind)


def _batch(rows: list[tuple | list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_column(*x) for x in zip(_ARROW.names, zip(*rows))], schema=_ARROW)


def _flatten_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Rows of a kind go together, so that the columns they don't have cost nothing.
    kinds: dict[str, list[tuple | list]] = defaultdict(list)
    count = 0
    for batch in batches:
        # Rows hold no cycles, so the collector would only go over all that wait, again and again.
        collects = gc.isenabled()
        gc.disable()
        try:
            for name, content in zip(batch.column("piece_id"), batch.column("content"), strict=True):
                found = flatten_document(content.as_py(), name.as_py())
                for row in found:
                    kinds[row[1]].append(row)
                count += len(found)
                if count >= BATCH_ROWS:
                    yield from map(_batch, kinds.values())
                    kinds.clear()
                    count = 0
        finally:
            if collects:
                gc.enable()
    yield from map(_batch, kinds.values())


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Score documents under a folder with their bytes, each named by its path below the folder.

    In a flat folder that is the file's name; equal names in two subfolders stay two pieces.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mei").option("recursiveFileLookup", True).load(path)
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/") + "/"
    below = F.when(F.startswith("path", F.lit(root)), F.substring("path", len(root) + 1, 1 << 30))
    return with_names(files).withColumn("piece_id", F.coalesce(below, "piece_id"))


def with_names(files: DataFrame) -> DataFrame:
    """Files named by the last part of their path, without blanks around it."""
    name = F.trim(F.element_at(F.split("path", "/"), -1))
    return files.select(name.alias("piece_id"), "path", F.col("length").alias("n_bytes"), "content")


def elements(documents: DataFrame) -> DataFrame:
    """Flattened documents. Store the result: every other table is read from it."""
    return documents.select("piece_id", "content").mapInArrow(_flatten_batches, ELEMENTS)


def scores(rows: DataFrame) -> DataFrame:
    """Whether each document is a well-formed score, why not, and the digest of its bytes."""
    return rows.filter("kind = 'score'").select(
        "piece_id", F.col("text").isNull().alias("is_valid"), F.col("text").alias("error"), F.col("tag").alias("sha256")
    )


def metadata(rows: DataFrame) -> DataFrame:
    """Header fields of every valid document."""

    text, tag, role = F.col("text"), F.col("tag"), F.lower(F.element_at("attrs", "role"))
    person = "titleStmt/respStmt/persName"
    # What a row can be asked for; other rows of the header are left out before anything is shuffled.
    field = (
        F.when(tag.endswith("/titleStmt/title"), "title")
        .when(tag == person, F.when(role.isin("composer", "mei_editor", "xml_editor", "analyst"), role))
        .when(tag.endswith("/pubStmt/date"), "date")
        .when(tag.endswith("/pubStmt/availability"), "availability")
        .when(tag == "appInfo/application/name", "application")
        .when(tag == "workList/work/title", "work_title")
    )
    # The first of a kind counts, also one that says nothing.
    value = (
        F.when(tag == person, text)
        .when(tag.endswith("/pubStmt/date"), F.element_at("attrs", "isodate"))
        .otherwise(F.when(text != "", text))
    )
    is_head = F.col("kind") == "head"
    keep = rows.filter("kind = 'head' or (kind = 'score' and text is null)").select(
        "piece_id", F.when(is_head, F.struct("pos", field.alias("field"), value.alias("value"))).alias("entry")
    ).filter("entry is null or entry.field is not null")
    # One sorted list a piece is all that is gathered, instead of a buffer for each column.
    found = keep.groupBy("piece_id").agg(F.sort_array(F.collect_list("entry")).alias("header"))

    def named(wanted: str) -> Column:
        return F.transform(F.filter("header", lambda e: e["field"] == wanted), lambda e: e["value"])

    def first(wanted: str) -> Column:
        return F.try_element_at(named(wanted), F.lit(1))

    return found.select(
        "piece_id",
        first("title").alias("title"),
        F.try_element_at(named("composer"), F.lit(-1)).alias("composer"),
        named("mei_editor").alias("mei_editors"),
        named("xml_editor").alias("xml_editors"),
        named("analyst").alias("analysts"),
        first("date").alias("publication_date"),
        first("availability").alias("availability"),
        first("application").alias("application"),
        first("work_title").alias("work_title"),
    ).withColumn("published", F.col("publication_date").try_cast("date"))


def measures(rows: DataFrame) -> DataFrame:
    attr = F.col("attrs")
    return rows.filter("kind = 'measure'").select(
        "piece_id",
        F.coalesce("section_seq", F.lit(0)).alias("section_seq"),
        "measure_seq",
        F.coalesce(F.element_at(attr, "n").try_cast("double"), F.lit(0.0)).alias("n"),
        F.element_at(attr, "left").alias("left"),
        F.element_at(attr, "right").alias("right"),
        "ending_seq",
        F.when(
            F.col("ending_seq").isNotNull(),
            ending_numbers(F.element_at(attr, "ending.n"), F.element_at(attr, "ending.label")),
        ).alias("ending_passes"),
        F.coalesce("after_other", F.lit(False)).alias("after_other"),
    )


def _times(timing: str) -> Column:
    if timing not in TIMINGS:
        raise ValueError("timing must be 'written' or 'encoded'")
    return F.col(timing)


def timeline(rows: DataFrame, timing: str = "written") -> DataFrame:
    """Where each measure of a piece starts and how long it is, over all its parts.

    A measure is as long as its longest voice, before ties are merged, so pickups are short; one that no
    voice fills has the length of the metre in force, or four quarters.
    """
    times = _times(timing)
    return rows.filter("kind = 'measure'").select(
        "piece_id", "measure_seq", times["start"].alias("start_ppq"), times["ticks"].alias("length_ppq")
    )


def note_events(rows: DataFrame, timing: str = "written", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The note-event table of flattened documents, ties merged.

    An event starts where its measure does (see ``timeline``) plus what comes
    before it in its own layer, so voices that enter late or pause meet the others.
    ``timing='written'`` gives events without stated ticks a length from their
    note value and rests of a whole measure the length of the measure;
    ``'encoded'`` skips the former and makes the latter four quarters. Events of unknown length are kept with
    length 0 and ``missing_dur``.
    """
    times = _times(timing)

    def written(note: Column) -> Column:
        def get(name: str) -> Column:
            return F.element_at(note, name)

        sounding = pitch.first_nonempty(get("accid.ges"), get("child.accid.ges"), get("accid"), get("child.accid"))
        printed = pitch.first_nonempty(get("accid.ges"), get("accid"), get("child.accid"))
        return F.struct(
            F.lower(get("pname")).alias("letter"), get("oct").try_cast("int").alias("octave"), sounding.alias("sounding"),
            printed.alias("printed"), get("vel").try_cast("int").alias("vel"), get("id").alias("id"),
        )

    def valued(note: Column) -> Column:
        return F.struct(
            pitch.lookup(pitch.LETTER_STEPS, note["letter"]).alias("step"),
            (12 * (note["octave"] + 1) + pitch.lookup(pitch.LETTER_SEMITONES, note["letter"])
             + pitch.accidental_semitones(note["sounding"])).cast("int").alias("midi"),
            pitch.spelled_pitch_class(note["letter"], note["printed"]).alias("written_pc"),
            note["octave"].alias("octave"), note["vel"].alias("vel"), note["id"].alias("id"),
        )

    def spelled(note: Column) -> Column:
        return F.struct(
            note["midi"].alias("midi"),
            pitch.pitch_class(note["midi"]).alias("pc"),
            note["written_pc"].alias("written_pc"),
            (7 * note["octave"] + note["step"]).cast("int").alias("dpos"),
            note["vel"].alias("vel"),
            note["id"].alias("id"),
        )

    # Step by step, since an expression is worked out again wherever it is named twice.
    valid = F.filter(F.transform(F.transform("notes", written), valued), lambda p: p["midi"].isNotNull())
    pitched = F.transform(valid, spelled)
    # Only notes that a tie joins to the event before them ask for its pitches.
    before = F.transform(F.transform(F.transform("notes_before", written), valued), lambda p: p["midi"])
    own = F.coalesce("attrs", F.get("notes", F.lit(0)))  # attributes of a note stand with its pitch alone
    located = rows.filter("kind = 'event'").withColumn("pitches", pitched).withColumns({
        "pitches": F.when(F.size("pitches") > 0, F.col("pitches")),
        "midi_before": F.array_max(before),
        "written_ids": F.filter(F.transform("notes", lambda n: F.element_at(n, "id")), lambda x: x.isNotNull()),
        "tied": F.exists("notes", lambda n: F.element_at(n, "tied").isNotNull()
                         | F.coalesce(F.element_at(n, "tie").isin("m", "t"), F.lit(False))),
        "fermata": F.element_at("attrs", "fermata").isNotNull()
        | F.exists("notes", lambda n: F.element_at(n, "held").isNotNull() | F.element_at(n, "fermata").isNotNull()),
        "missing_dur": F.element_at(own, "dur.ppq").isNull() & ~F.col("tag").isin("mRest", "mSpace"),
    })
    top = F.array_max(F.transform("pitches", lambda p: F.struct(p["midi"].alias("midi"), p["dpos"].alias("dpos"))))
    located = located.withColumn("top", top)
    events = located.select(
        "piece_id", "part", "staff", "seq",
        (times["start"] + times["earlier"]).alias("onset_ppq"),
        times["ticks"].alias("dur_ppq"),
        F.col("piece_ppq").alias("ppq"),
        F.coalesce(F.col("text").try_cast("double"), F.lit(0.0)).alias("measure"),
        "measure_seq", times["earlier"].alias("measure_onset_ppq"), "meter_count", "meter_unit",
        F.col("top.midi").alias("midi"),
        F.col("top.dpos").alias("dpos"),
        "pitches",
        F.when(F.col("top").isNotNull(), F.col("written_ids")).alias("note_ids"),
        "fermata", "section_start",
        F.coalesce(F.col("tied") & (F.col("midi_before") == F.col("top.midi")), F.lit(False)).alias("tied_from_prev"),
        "missing_dur", "part_tied",
    )
    # Parts without ties stay as the walk has numbered them; a part is no longer than its document, which one task has read.
    earlier = Window.partitionBy(*PART).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    free = events.filter("not part_tied").withColumn(
        "note_place", F.when(F.col("midi").isNotNull(), F.count("midi").over(earlier))
    )
    joined = merge_ties(store(events.filter("part_tied").drop("part_tied"), "untied-events"), block_rows)
    return joined.unionByName(free.select(joined.columns))
