"""The given tables seen as music: rows become notes of pieces and parts.

``events`` gives ten pieces of five parts; ``lineitem`` a hundred pieces of
seven. Both are deliberately hard on a cluster: the number of pieces is fixed,
so every voice grows with the data and no window may hold a whole voice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import pitch
from noteloom.operators.notes import PART
from noteloom.operators.ordered import halo, neighbours, running, settle
from noteloom.sources import mei
from noteloom.sources.tables import stored_once

PPQ = 480
MEASURE_PPQ = 4 * PPQ

# A block of event ids holds at most that many rows, since the id is unique; a
# block of order keys at most that many orders.
EVENT_BLOCK = 1 << 18
ORDER_BLOCK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_time(df: DataFrame, piece: str, order: list[str], block: Column, made: dict[str, Column]) -> DataFrame:
    """Number the rows of each part, lay them end to end, and spell the pitches.

    ``df`` has the plain numbers that the rows are ``made`` of: only those are shuffled, sorted and spilled.
    """
    timed = running(
        df, ["piece", "part"], order, block,
        sums={
            "earlier": F.lit(1),
            "onset_ppq": made["dur_ppq"],
            "note_place": made["midi"].isNotNull().cast("int"),
        },
    )
    timed = timed.withColumns({"piece_id": F.concat(F.lit(piece), "piece"), **made})
    midi = F.col("midi")
    return timed.select(
        "piece_id",
        "part",
        F.col("part").cast("string").alias("staff"),
        (F.col("earlier") + 1).cast("bigint").alias("seq"),
        F.when(midi.isNotNull(), F.col("note_place").cast("bigint")).alias("note_place"),
        F.col("onset_ppq").cast("bigint").alias("onset_ppq"),
        "dur_ppq",
        F.lit(PPQ).alias("ppq"),
        F.expr(f"cast(onset_ppq div {MEASURE_PPQ} + 1 as double)").alias("measure"),
        F.expr(f"onset_ppq div {MEASURE_PPQ} + 1").alias("measure_seq"),
        F.expr(f"cast(onset_ppq % {MEASURE_PPQ} as bigint)").alias("measure_onset_ppq"),
        F.lit(4).alias("meter_count"),
        F.lit(4).alias("meter_unit"),
        midi,
        pitch.midi_to_diatonic(midi).alias("dpos"),
        F.when(
            midi.isNotNull(),
            F.array(
                F.struct(
                    midi.alias("midi"),
                    pitch.pitch_class(midi).alias("pc"),
                    F.col("vel").alias("vel"),
                )
            ),
        ).alias("pitches"),
        F.when(midi.isNotNull(), F.array("note_id")).alias("note_ids"),
        "fermata",
        F.lit(False).alias("section_start"),
    )


def project_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("cast(floor(value) as bigint)")
    part = (
        F.when(F.col("event_type") == "click", 1)
        .when(F.col("event_type") == "error", 2)
        .when(F.col("event_type") == "purchase", 3)
        .when(F.col("event_type") == "signup", 4)
        .otherwise(5)
    )
    rows = table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 10).alias("piece"), part.alias("part"), value.alias("v")
    )
    made = {
        "dur_ppq": F.expr("cast(120 * (1 + event_id % 4) as bigint)"),
        "midi": F.when(F.col("v") % 11 != 0, (78 - 5 * F.col("part") + F.col("v") % 8).cast("int")),
        "vel": (F.col("v") % 128).cast("int"),
        "fermata": F.col("event_id") % 97 == 0,
        "note_id": F.concat(F.lit("e"), F.col("event_id")),
    }
    return _with_time(rows, "u", ["event_id"], F.expr(f"event_id div {EVENT_BLOCK}"), made)


def project_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        (F.col("l_suppkey") % 100).alias("piece"),
        F.col("l_linenumber").alias("part"),
        F.expr("cast(l_quantity as bigint)").alias("q"),
    )
    made = {
        "dur_ppq": (120 * (1 + F.col("q") % 4)).cast("bigint"),
        "midi": F.when(F.col("q") % 11 != 0, (78 - 5 * F.col("part") + F.col("q") % 8).cast("int")),
        "vel": (F.col("q") % 128).cast("int"),
        "fermata": F.lit(False),
        "note_id": F.concat_ws("-", "l_orderkey", "part", "l_partkey", "l_suppkey"),
    }
    order = ["l_orderkey", "l_partkey", "l_suppkey"]
    return _with_time(rows, "s", order, F.expr(f"l_orderkey div {ORDER_BLOCK}"), made)


def note_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stored note-event table, built once per application."""
    return stored_once(spark, f"events:{sf_dir}", lambda: project_events(spark, sf_dir), f"{sf_dir}/events.parquet")


def note_events_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_once(spark, f"lineitem:{sf_dir}", lambda: project_lineitem(spark, sf_dir), f"{sf_dir}/lineitem.parquet")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece u<k> carries the name of nation k as its composer."""
    nation = table(spark, sf_dir, "nation")
    return nation.select(
        F.concat(F.lit("u"), F.col("n_nationkey")).alias("piece_id"),
        F.concat(F.lit("Piece "), F.col("n_nationkey")).alias("title"),
        F.col("n_name").alias("composer"),
        F.col("n_nationkey").cast("bigint").alias("score_index"),
    )


def meter_missing(events: DataFrame, pieces: list[str]) -> DataFrame:
    """The same events with no metre stated in some pieces."""
    unknown = F.col("piece_id").isin(pieces)
    return events.withColumns(
        {c: F.when(~unknown, F.col(c)) for c in ("meter_count", "meter_unit")}
    )


def tie_flags(events: DataFrame) -> DataFrame:
    """Every repeated pitch on a place divisible by three is tied to the note before."""
    same = F.lag("midi").over(neighbours(PART, "seq")) == F.col("midi")
    tied = F.coalesce(same & (F.col("seq") % 3 == 0), F.lit(False))
    return settle(halo(events, "seq", before=1).withColumn("tied_from_prev", tied))


def spans(events: DataFrame) -> DataFrame:
    """Each event asks for notes around it, in one of five ways."""
    kind = F.col("seq") % 5
    start_q = F.col("onset_ppq") / F.col("ppq")
    part = F.col("part").cast("string")
    return events.select(
        "piece_id",
        (F.col("seq") * 8 + F.col("part")).alias("index"),
        F.when(kind.isin(2, 3), F.col("measure")).alias("start_measure"),
        F.when(kind.isin(2, 3), 1 + F.col("measure_onset_ppq") / F.col("ppq")).alias("start_beat"),
        F.when(kind.isin(0, 1, 2), start_q).alias("start_q"),
        F.when(kind == 4, start_q).alias("start_offset"),
        F.when(kind == 0, start_q + 2).alias("end_q"),
        F.when(kind == 1, F.lit(2.0)).alias("duration"),
        F.when(kind == 2, 3).when(kind == 4, 2).alias("note_count"),
        F.when(kind == 0, part).alias("column"),
        F.when(kind == 2, part).alias("part"),
        F.when(kind == 4, F.lit("2_1")).alias("voice_pair"),
    )


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as measures: priority and status place repeat signs and endings."""
    key = F.col("o_orderkey")
    sign = F.concat_ws(" ", "o_orderpriority", "o_orderstatus")
    ending = sign == "2-HIGH P"
    passes = (
        F.when(key % 4 == 0, F.array(F.lit(1)))
        .when(key % 4 == 1, F.array(F.lit(2)))
        .when(key % 4 == 3, F.array(F.lit(1), F.lit(2)))
        .otherwise(F.array().cast("array<int>"))
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), F.col("o_custkey") % 10).alias("piece_id"),
        F.expr("o_orderkey div 4000 + 1").alias("section_seq"),
        key.alias("measure_seq"),
        key.cast("double").alias("n"),
        F.when(sign == "1-URGENT O", F.lit("rptstart")).alias("left"),
        F.when(sign == "5-LOW F", F.lit("rptend")).alias("right"),
        F.when(ending, key).alias("ending_seq"),
        F.when(ending, passes).alias("ending_passes"),
        (ending & (F.col("o_totalprice") > 250000)).alias("after_other"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as score files, once built in and once registered."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    prefix = F.element_at(
        F.array(*[F.lit(p) for p in ("Bach", "Bartok", "Morley", "CRIM", "Other")]), (F.col("doc_id") % 5 + 1).cast("int")
    )

    def files(source: str, folder: str, per: int) -> DataFrame:
        return docs.select(
            F.concat(prefix, F.lit("_"), F.expr(f"doc_id div {per}"), F.lit(".mei")).alias("filename"),
            F.concat(F.lit(folder), F.col("doc_id")).alias("path"),
            F.lit(source).alias("source"),
            F.col("doc_id").alias("registered_at"),
        )

    return files("builtin", "/scores/", 5).unionByName(files("registered", "/inbox/", 7))


def removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.element_at(
        F.array(*[F.lit(p) for p in ("Bach", "Bartok", "Morley", "CRIM", "Other")]), (F.col("item_id") % 5 + 1).cast("int")
    )
    return table(spark, sf_dir, "benchmark").select(
        F.concat(prefix, F.lit("_"), F.col("item_id"), F.lit(".mei")).alias("filename")
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as cells of a written note table, many of them spoiled: wrong letters and accidentals, no or huge octaves."""
    def pick(values: list[str], index: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))

    letter = pick(["C", "D", "E", "F", "G", "A", "B", "H", "Rest"], F.col("l_partkey") % 9)
    mark = pick(["", "#", "-", "x"], F.col("l_suppkey") % 4)
    octave = pick(["0", "1", "2", "3", "4", "5", "", "4000000000"], F.expr("cast(l_quantity as bigint) % 8"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("l"), F.col("l_orderkey") % 100).alias("piece_id"),
        F.col("l_linenumber").cast("int").alias("part"),
        F.when(F.col("l_partkey") % 31 == 0, None)
        .when(F.col("l_partkey") % 9 == 8, "Rest")
        .otherwise(F.concat(F.lit(" "), letter, mark, octave)).alias("token"),
    )


def texts_as_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under the names of score files: whole contents that are no scores."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("text_"), "doc_id", F.lit(".mei")).alias("piece_id"), F.encode("text", "utf-8").alias("content")
    )


def registry_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations and removals of score files in one order: documents add names, benchmark items remove them."""
    def name(column: str, per: int) -> Column:
        return F.concat(F.lit("Score_"), F.expr(f"{column} div {per}"), F.lit(".mei"))

    added = table(spark, sf_dir, "documents").select(
        name("doc_id", 3).alias("filename"), (F.col("doc_id") * 2).alias("number"), F.lit(True).alias("added"),
        F.concat(F.lit("/inbox/"), "doc_id").alias("path"),
    )
    removed = table(spark, sf_dir, "benchmark").select(
        name("item_id", 1).alias("filename"), (F.col("item_id") * 6 + 2).alias("number"), F.lit(False).alias("added"),
        F.lit(None).cast("string").alias("path"),
    )
    return added.unionByName(removed)


def measures_of(events: DataFrame) -> DataFrame:
    """The measures of projected events, with a repeat in every eight of them."""
    seq = F.col("measure_seq")
    return events.select("piece_id", "measure_seq").distinct().select(
        "piece_id",
        F.lit(1).cast("bigint").alias("section_seq"),
        "measure_seq",
        seq.cast("double").alias("n"),
        F.when(seq % 8 == 3, F.lit("rptstart")).alias("left"),
        F.when(seq % 8 == 6, F.lit("rptend")).alias("right"),
        F.lit(None).cast("bigint").alias("ending_seq"),
        F.lit(None).cast("array<int>").alias("ending_passes"),
        F.lit(False).alias("after_other"),
        F.lit(MEASURE_PPQ).cast("bigint").alias("length_ppq"),
    )


def score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order written as a small MEI document of four measures; its lines are the notes.

    Lines go by twos into the measures, an odd and an even one to two staves; lines
    whose supplier number divides by five sound in a third staff instead, which so enters late or
    pauses, and whose notes are tied to the one before. An order without lines is a score with empty measures.
    Orders of some kinds give broken documents: another root element, a cut end, an encoding nobody knows,
    elements nested beyond reason, and numbers that are none or too large (the last two are read without them).
    """
    quantity = F.expr("cast(l_quantity as bigint)")

    def pick(values: list[str], index: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))

    timing = pick(['dur.ppq="960"', 'dur="4"', 'dur="8" dots="1"', 'dur.ppq="120"'], quantity % 4)
    accidental = pick(["", ' accid="s"', ' accid.ges="f"', ""], F.col("l_suppkey") % 4)
    inner = F.when(F.col("l_suppkey") % 4 == 3, F.lit('<accid accid="ff"/>')).otherwise(F.lit(""))
    third = F.col("l_suppkey") % 5 == 0
    id = F.concat(F.lit('<note xml:id="n'), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber"))
    free = F.concat(
        id, F.lit('" pname="'), pick(list("cdefgab"), F.col("l_partkey") % 7), F.lit('" oct="'),
        (3 + quantity % 3).cast("string"), F.lit('" '), timing, accidental, F.lit(">"), inner, F.lit("</note>"),
    )
    held = F.concat(id, F.lit('" pname="c" oct="6" tie="m" '), timing, F.lit("/>"))
    sounding = F.when(third, held).otherwise(free)
    event = F.when(quantity % 11 == 0, F.concat(F.lit("<rest "), timing, F.lit("/>"))).otherwise(sounding)
    measure = F.expr("cast((l_linenumber - 1) div 2 as int)")
    staff = F.when(third, 3).otherwise(1 + F.col("l_linenumber") % 2)
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.struct(
            measure.alias("measure"), staff.alias("staff"), "l_partkey", "l_suppkey", "l_linenumber", event.alias("xml")
        ).alias("line"),
    ).filter(F.col("line.measure").between(0, 3))
    # One shuffle brings the lines of an order together; the rest is done inside its array.
    bodies = lines.groupBy("o_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    # Not broadcast: the parsing that follows is then spread by orders, not by the files of their table.
    orders = table(spark, sf_dir, "orders").join(bodies.hint("merge"), "o_orderkey", "left")

    # Lines are sorted, so one pass over them writes the document: each opens what the one before it has not opened.
    begins = [f'<measure n="{7 + n}"{signs}>' for n, signs in enumerate(('', ' left="rptstart"', ' right="rptend"', ''))]
    end, ends = "</layer></staff>", "</measure>"

    def steps(before: int, to: int) -> str:
        """From inside a staff of one measure (-1: from before the first) to inside another (4: behind the last)."""
        passed = begins[before + 1 : to + 1]
        return (end + ends if before >= 0 else "") + ends.join(passed) + (ends if passed and to == 4 else "")

    def step(before: Column, to: Column) -> Column:
        return pick([steps(b, t) if b < t else "" for b in range(-1, 4) for t in range(5)], (before + 1) * 5 + to)

    def written(line: Column, place: Column) -> Column:
        before = F.get("lines", place - 1)
        since = F.coalesce(before["measure"], F.lit(-1))
        opened = F.when(since < line["measure"], step(since, line["measure"])).when(before["staff"] < line["staff"], end)
        staff = pick([f'<staff n="{n}"><layer n="1">' for n in (1, 2, 3)], line["staff"] - 1)
        return F.concat(F.when(opened.isNotNull(), F.concat(opened, staff)).otherwise(""), F.coalesce(line["xml"], F.lit("")))

    last = F.coalesce(F.try_element_at("lines", F.lit(-1))["measure"], F.lit(-1))
    body = F.concat(F.coalesce(F.array_join(F.transform("lines", written), ""), F.lit("")), step(last, F.lit(4)))
    sign = F.concat_ws(" ", "o_orderpriority", "o_orderstatus")
    odd = F.col("o_orderkey") % 16
    root = F.when(sign == "5-LOW F", F.lit("score")).otherwise(F.lit("mei"))
    declared = F.when(sign == "3-MEDIUM F", F.lit('<?xml version="1.0" encoding="no-such-code"?>')).otherwise(F.lit(""))
    ppq = F.when(odd == 1, F.lit(' ppq="\u00b2"')).when(odd == 2, F.lit(' ppq="99999999999"')).otherwise(F.lit(' ppq="480"'))
    deep = F.when(F.col("o_orderkey") % 512 == 3, 2000).otherwise(0)
    text = F.concat(
        declared, F.lit("<"), root, F.lit(' xmlns="http://www.music-encoding.org/ns/mei"><meiHead><fileDesc><titleStmt><title>Order '),
        F.col("o_orderkey"), F.lit('</title><respStmt><persName role="composer">Customer '), F.col("o_custkey"),
        F.lit('</persName><persName role="analyst">'), F.col("o_orderpriority"),
        F.lit('</persName></respStmt></titleStmt><pubStmt><date isodate="'), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit('"/></pubStmt></fileDesc></meiHead><music><body><mdiv><score><scoreDef'), ppq,
        F.lit(' meter.count="3" meter.unit="4"/><section>'),
        F.repeat(F.lit("<supplied>"), deep), body, F.repeat(F.lit("</supplied>"), deep),
        F.lit("</section></score></mdiv></body></music></"), root, F.lit(">"),
    )
    cut = F.when(sign == "1-URGENT O", F.substring(text, F.lit(1), F.length(text) - 10)).otherwise(text)
    return orders.select(
        F.concat(F.lit("order_"), F.col("o_orderkey"), F.lit(".mei")).alias("piece_id"), cut.cast("binary").alias("content")
    )


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [f"{sf_dir}/{name}.parquet" for name in ("orders", "lineitem")]
    return stored_once(spark, f"documents:{sf_dir}", lambda: mei.elements(score_documents(spark, sf_dir)), *sources)
