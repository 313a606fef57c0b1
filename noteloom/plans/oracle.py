"""SQL twins of the registered queries, over the given tables."""

from __future__ import annotations

EVENTS = """
WITH base AS (
  SELECT event_id, concat('u', user_id % 10) AS piece_id,
         CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
                         WHEN 'signup' THEN 4 ELSE 5 END AS part,
         CAST(floor(value) AS BIGINT) AS v,
         CAST(120 * (1 + event_id % 4) AS BIGINT) AS dur_ppq
  FROM events),
raw_events AS (
  SELECT piece_id, part, dur_ppq, v,
         row_number() OVER (PARTITION BY piece_id, part ORDER BY event_id) AS seq,
         CASE WHEN v % 11 = 0 THEN NULL ELSE CAST(78 - 5 * part + v % 8 AS INTEGER) END AS midi,
         CAST(coalesce(sum(dur_ppq) OVER (PARTITION BY piece_id, part ORDER BY event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS onset_ppq,
         event_id % 97 = 0 AS fermata, event_id,
         concat('e', event_id) AS note_id
  FROM base)
"""

LINEITEM = """
WITH base AS (
  SELECT l_orderkey, l_partkey, l_suppkey, concat('s', l_suppkey % 100) AS piece_id, l_linenumber AS part,
         CAST(l_quantity AS BIGINT) AS v,
         CAST(120 * (1 + CAST(l_quantity AS BIGINT) % 4) AS BIGINT) AS dur_ppq,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS note_id
  FROM lineitem),
raw_events AS (
  SELECT piece_id, part, dur_ppq, v,
         row_number() OVER (PARTITION BY piece_id, part ORDER BY l_orderkey, l_partkey, l_suppkey) AS seq,
         CASE WHEN v % 11 = 0 THEN NULL ELSE CAST(78 - 5 * part + v % 8 AS INTEGER) END AS midi,
         CAST(coalesce(sum(dur_ppq) OVER (PARTITION BY piece_id, part ORDER BY l_orderkey, l_partkey, l_suppkey
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS onset_ppq,
         false AS fermata, note_id
  FROM base)
"""

# Adds measure, beat, end, pitch class, octave and diatonic position.
NOTES = """,
note_events AS (
  SELECT *, onset_ppq + dur_ppq AS end_ppq,
         CAST(onset_ppq // 1920 + 1 AS DOUBLE) AS measure,
         1 + (onset_ppq % 1920) / 480.0::DOUBLE AS beat,
         midi % 12 AS pc, midi // 12 - 1 AS oct,
         7 * (midi // 12 - 1) + [0,0,1,2,2,3,3,4,5,5,6,6][midi % 12 + 1] AS dpos,
         ['C','C#','D','E-','E','F','F#','G','A-','A','B-','B'][midi % 12 + 1]
           || CAST(midi // 12 - 1 AS VARCHAR) AS token
  FROM raw_events)
"""


def quality(m0: str, d0: str, m1: str, d1: str) -> str:
    """Interval with quality from pitch (m0, d0) to pitch (m1, d1)."""
    size = f"abs({d1} - {d0})"
    down = f"({d1} < {d0} OR ({d1} = {d0} AND {m1} < {m0}))"
    delta = (f"((CASE WHEN {down} THEN {m0} - {m1} ELSE {m1} - {m0} END)"
             f" - [0,2,4,5,7,9,11][{size} % 7 + 1] - 12 * ({size} // 7))")
    return f"""
      CASE WHEN {m0} IS NULL OR {m1} IS NULL THEN NULL ELSE
        concat(CASE WHEN {down} THEN '-' ELSE '' END,
          CASE WHEN {size} % 7 IN (0, 3, 4) THEN
                 CASE WHEN {delta} = 0 THEN 'P' WHEN {delta} > 0 THEN repeat('A', {delta})
                      ELSE repeat('d', -{delta}) END
               ELSE CASE WHEN {delta} = 0 THEN 'M' WHEN {delta} = -1 THEN 'm'
                         WHEN {delta} > 0 THEN repeat('A', {delta}) ELSE repeat('d', -{delta} - 1) END
          END, {size} + 1) END"""


def step(kind: str, m0: str, d0: str, m1: str, d1: str) -> str:
    if kind == "c":
        return f"CAST({m1} - {m0} AS VARCHAR)"
    if kind == "z":
        return f"CAST({d1} - {d0} AS VARCHAR)"
    if kind == "d":
        return (f"CAST(CASE WHEN {d1} >= {d0} THEN {d1} - {d0} + 1 ELSE {d1} - {d0} - 1 END AS VARCHAR)")
    return quality(m0, d0, m1, d1)


NOTE_TABLE = """
SELECT piece_id, part, measure, beat, onset_ppq, coalesce(token, 'Rest') AS token
FROM (SELECT *, lag(midi) OVER w AS before, lag(seq) OVER w AS before_seq FROM note_events
      WINDOW w AS (PARTITION BY piece_id, part ORDER BY seq))
WHERE NOT (midi IS NULL AND before IS NULL AND before_seq IS NOT NULL)
"""


def melodic(kind: str) -> str:
    return f"""
SELECT piece_id, part, measure, beat, onset_ppq, value FROM (
  SELECT *, CASE WHEN midi IS NULL THEN CASE WHEN m0 IS NULL AND seq > 1 THEN NULL ELSE 'Rest' END
                 ELSE {step(kind, 'm0', 'd0', 'midi', 'dpos')} END AS value
  FROM (SELECT *, lag(midi) OVER w AS m0, lag(dpos) OVER w AS d0 FROM note_events
        WINDOW w AS (PARTITION BY piece_id, part ORDER BY seq)))
WHERE value IS NOT NULL
"""


# Notes meet inside blocks of two quarters, so that a long piece is no join of all with all.
HARMONIC = f"""
SELECT a.piece_id, concat(a.part, '_', b.part) AS voice_pair,
       CASE WHEN a.onset_ppq >= b.onset_ppq THEN a.measure ELSE b.measure END AS measure,
       CASE WHEN a.onset_ppq >= b.onset_ppq THEN a.beat ELSE b.beat END AS beat,
       greatest(a.onset_ppq, b.onset_ppq) AS onset_ppq,
       coalesce({quality('a.midi', 'a.dpos', 'b.midi', 'b.dpos')}, 'Rest') AS value
FROM (SELECT *, unnest(range(onset_ppq // 960, (end_ppq - 1) // 960 + 1)) AS block FROM note_events WHERE end_ppq > onset_ppq) a
JOIN (SELECT *, unnest(range(onset_ppq // 960, (end_ppq - 1) // 960 + 1)) AS block FROM note_events WHERE end_ppq > onset_ppq) b
  ON a.piece_id = b.piece_id AND a.block = b.block AND a.part > b.part AND a.onset_ppq < b.end_ppq AND b.onset_ppq < a.end_ppq
WHERE greatest(a.onset_ppq, b.onset_ppq) // 960 = a.block
"""


def ngrams(n: int, kind: str = "d", source: str = "note_events") -> str:
    """Common table expressions ending in ``ngrams``."""
    nexts = " || '_' || ".join(["step", *[f"lead(step, {k}) OVER w" for k in range(1, n)]])
    ids = ", ".join(["note_id", *[f"lead(note_id, {k}) OVER w" for k in range(1, n + 1)]])
    return f""",
steps AS (
  SELECT *, {step(kind, 'midi', 'dpos', 'm1', 'd1')} AS step FROM (
    SELECT *, lead(midi) OVER w AS m1, lead(dpos) OVER w AS d1 FROM {source}
    WINDOW w AS (PARTITION BY piece_id, part ORDER BY seq))),
ngrams AS (
  SELECT * FROM (
    SELECT *, {nexts} AS pattern_string, lead(end_ppq, {n}) OVER w AS last_end,
           concat_ws(',', {ids}) AS note_ids,
           lag(seq) OVER w IS NULL OR lag(midi) OVER w IS NULL OR coalesce(lag(fermata) OVER w, false) AS opens
    FROM steps WINDOW w AS (PARTITION BY piece_id, part ORDER BY seq))
  WHERE pattern_string IS NOT NULL)
"""


# Consecutive rests and repeated pitches merged; ids of the first member.
MERGED = """,
flagged AS (
  SELECT *, CASE WHEN before_seq IS NULL THEN true
                 WHEN midi IS NULL AND before IS NULL THEN false
                 ELSE midi IS DISTINCT FROM before END AS starts
  FROM (SELECT *, lag(midi) OVER w AS before, lag(seq) OVER w AS before_seq FROM note_events
        WINDOW w AS (PARTITION BY piece_id, part ORDER BY seq))),
merged AS (
  SELECT piece_id, part, row_number() OVER w AS seq, measure, beat, onset_ppq, midi, dpos, note_id, fermata,
         coalesce(lead(onset_ppq) OVER w, part_end) AS end_ppq
  FROM (SELECT f.*, max(end_ppq) OVER (PARTITION BY piece_id, part) AS part_end FROM flagged f)
  WHERE starts WINDOW w AS (PARTITION BY piece_id, part ORDER BY seq))
"""

NGRAM_ROWS = "SELECT piece_id, part, seq, measure, beat, onset_ppq, pattern_string FROM ngrams"

NGRAM_COUNTS = """
SELECT piece_id, pattern_string, count(*) AS count FROM ngrams GROUP BY piece_id, pattern_string
"""

NGRAM_MATCHES = """
SELECT piece_id, pattern_string, part, measure, beat, onset_ppq, last_end - onset_ppq AS dur_ppq,
       last_end AS end_ppq, note_ids FROM ngrams
"""

FIRST_OCCURRENCES = """
SELECT piece_id, pattern_string, total AS count, onset_ppq / 480.0::DOUBLE AS start_q,
       (last_end - onset_ppq) / 480.0::DOUBLE AS duration, last_end / 480.0::DOUBLE AS end_q, part, note_ids
FROM (SELECT *, count(*) OVER (PARTITION BY piece_id, pattern_string) AS total,
             row_number() OVER (PARTITION BY piece_id, pattern_string ORDER BY onset_ppq, part) AS place
      FROM ngrams)
WHERE place = 1
"""

# Pitch-class weights --------------------------------------------------------

FIFTHS = "['C','G','D','A','E','B','F#','C#','A-','E-','B-','F']"
CHROMATIC = "['C','C#','D','E-','E','F','F#','G','A-','A','B-','B']"


def weights(by_staff: bool = False, active_only: bool = True, order: str = FIFTHS) -> str:
    keys = "piece_id, staff" if by_staff else "piece_id"
    keep = "WHERE EXISTS (SELECT 1 FROM sounding x WHERE x.pc = g.pc)" if active_only else ""
    return f""",
sounding AS (SELECT *, CAST(part AS VARCHAR) AS staff FROM note_events WHERE midi IS NOT NULL),
sums AS (SELECT {keys}, pc, sum(dur_ppq) AS weight FROM sounding GROUP BY {keys}, pc),
totals AS (SELECT {keys}, sum(dur_ppq) AS total, count(*) AS note_count FROM sounding GROUP BY {keys}),
grid AS (SELECT t.*, CAST(k.pc AS INTEGER) AS pc FROM totals t, range(12) k(pc))
SELECT {keys}, {CHROMATIC}[g.pc + 1] AS pc_label,
       CAST(list_position({order}, {CHROMATIC}[g.pc + 1]) - 1 AS INTEGER) AS position,
       CAST(coalesce(weight, 0) AS BIGINT) AS weight_ppq,
       round(coalesce(weight, 0) / CAST(total AS DOUBLE), 9) AS share, note_count
FROM grid g LEFT JOIN sums USING ({keys}, pc) {keep}
"""


PITCH_NAMES = """
SELECT midi, token, midi AS midi_again, pc,
       CAST(count(*) AS BIGINT) AS notes FROM note_events WHERE midi IS NOT NULL GROUP BY ALL
"""

KEYS = f""",
profiles(mode, degree, weight) AS (VALUES
  {", ".join(f"('major', {i}, {w})" for i, w in enumerate(
      [17.7661, 0.145624, 14.9265, 0.160186, 19.8049, 11.3587, 0.291248, 22.062, 0.145624, 8.15494, 0.232998, 4.95122]))},
  {", ".join(f"('minor', {i}, {w})" for i, w in enumerate(
      [18.2648, 0.737619, 14.0499, 16.8599, 0.702494, 14.4362, 0.702494, 18.6161, 4.56621, 1.93186, 7.37619, 1.75623]))}),
sums AS (SELECT piece_id, pc, sum(dur_ppq) AS weight FROM note_events WHERE midi IS NOT NULL GROUP BY piece_id, pc),
grid AS (SELECT piece_id, k.pc, coalesce(weight, 0) AS weight
         FROM (SELECT DISTINCT piece_id FROM sums) CROSS JOIN range(12) k(pc) LEFT JOIN sums USING (piece_id, pc)),
fits AS (SELECT piece_id, mode, tonic, corr(CAST(g.weight AS DOUBLE), CAST(p.weight AS DOUBLE)) AS r
         FROM grid g CROSS JOIN range(12) t(tonic) JOIN profiles p ON p.degree = (g.pc - tonic + 12) % 12
         GROUP BY piece_id, mode, tonic),
keys AS (
  SELECT piece_id, CASE mode WHEN 'major' THEN {CHROMATIC}[tonic + 1] ELSE lower({CHROMATIC}[tonic + 1]) END
         || ' ' || mode AS key_name, round(r, 6) AS confidence
  FROM fits QUALIFY row_number() OVER (PARTITION BY piece_id ORDER BY r DESC, mode, tonic) = 1)
"""

RANGES = """,
ranges AS (
  SELECT piece_id, part, min(midi) AS lowest_midi, max(midi) AS highest_midi,
         arg_min(token, midi) AS lowest_note, arg_max(token, midi) AS highest_note,
         max(midi) - min(midi) AS range_semitones
  FROM note_events WHERE midi IS NOT NULL GROUP BY piece_id, part)
"""

RANGE_AXIS = """
SELECT piece_id, min(lowest_midi) AS x_min_midi, max(highest_midi) AS x_max_midi, count(*) AS staves,
       array_to_string(range(min(lowest_midi), max(highest_midi) + 1), ',') AS tick_values,
       array_to_string([['C','C#','D','E-','E','F','F#','G','A-','A','B-','B'][x % 12 + 1] || CAST(x // 12 - 1 AS VARCHAR)
                        FOR x IN range(min(lowest_midi), max(highest_midi) + 1)], ',') AS tick_labels
FROM ranges GROUP BY piece_id
"""

META = """,
metadata AS (SELECT concat('u', n_nationkey) AS piece_id, concat('Piece ', n_nationkey) AS title,
                    n_name AS composer, CAST(n_nationkey AS BIGINT) AS score_index FROM nation)
"""

TRACES = """
SELECT piece_id, staff, concat(title, ' - Staff ', staff) AS label,
       replace(lower(concat(title, ' - Staff ', staff)), ' ', '-') AS trace_id, note_count
FROM (SELECT piece_id, CAST(part AS VARCHAR) AS staff, count(*) AS note_count FROM note_events WHERE midi IS NOT NULL
      GROUP BY piece_id, part) JOIN metadata USING (piece_id)
"""

SUMMARY = """
SELECT count(DISTINCT piece_id) AS score_count, max(round(weight / CAST(total AS DOUBLE), 9)) AS radial_max,
       (SELECT string_agg(DISTINCT composer, ', ' ORDER BY composer) FROM metadata
        WHERE piece_id IN (SELECT piece_id FROM sums)) AS composer
FROM (SELECT piece_id, weight, sum(weight) OVER (PARTITION BY piece_id) AS total FROM sums)
"""

# Heatmap --------------------------------------------------------------------

TOP = """,
top AS (
  SELECT pattern_string, count(*) AS count FROM ngrams GROUP BY pattern_string
  ORDER BY count DESC, pattern_string LIMIT 3),
coloured AS (SELECT *, CAST((row_number() OVER (ORDER BY count DESC, pattern_string) - 1) % 8 AS INTEGER) AS colour FROM top)
"""

HEATMAP_ROWS = """
SELECT concat_ws('::', piece_id, part) AS id, piece_id, part, concat(title, ' - Staff ', part) AS label,
       coalesce(max(CASE WHEN midi IS NOT NULL THEN end_ppq END), 0) / 480.0::DOUBLE AS end_q
FROM note_events JOIN metadata USING (piece_id) GROUP BY piece_id, part, title
"""

HEATMAP_OCCURRENCES = """
SELECT concat_ws('::', piece_id, part, pattern_string, CAST(onset_ppq / 480.0::DOUBLE AS VARCHAR)) AS id,
       concat_ws('::', piece_id, part) AS row_id, piece_id, part, pattern_string,
       onset_ppq / 480.0::DOUBLE AS start_q, last_end / 480.0::DOUBLE AS end_q,
       (last_end - onset_ppq) / 480.0::DOUBLE AS duration, measure, beat, note_ids, colour
FROM ngrams JOIN coloured USING (pattern_string) WHERE last_end > onset_ppq
"""

# Span resolution ------------------------------------------------------------

SPANS = """,
placed AS (SELECT *, row_number() OVER (PARTITION BY piece_id, part ORDER BY seq) AS place
           FROM note_events WHERE midi IS NOT NULL),
spans AS (SELECT piece_id, seq * 8 + part AS index, seq % 5 AS kind, part, onset_ppq FROM note_events),
starts AS (
  SELECT s.piece_id, s.index, p.part, p.place AS from_place, CASE s.kind WHEN 2 THEN 3 ELSE 2 END AS note_count
  FROM spans s JOIN placed p ON p.piece_id = s.piece_id AND p.onset_ppq = s.onset_ppq
       AND (CASE s.kind WHEN 2 THEN p.part = s.part ELSE p.part IN (1, 2) END)
  WHERE s.kind IN (2, 4)),
hits AS (
  SELECT s.piece_id, s.index, p.part, p.part AS part_order, p.place, p.note_id
  FROM spans s JOIN placed p ON p.piece_id = s.piece_id AND p.onset_ppq >= s.onset_ppq
       AND p.onset_ppq < s.onset_ppq + 960 AND (s.kind = 1 OR p.part = s.part) WHERE s.kind IN (0, 1)
  UNION ALL
  SELECT s.piece_id, s.index, p.part, p.part, p.place, p.note_id
  FROM spans s JOIN placed p ON p.piece_id = s.piece_id AND p.onset_ppq = s.onset_ppq WHERE s.kind = 3
  UNION ALL
  SELECT s.piece_id, s.index, p.part, CASE s.note_count WHEN 2 THEN 3 - p.part ELSE p.part END, p.place, p.note_id
  FROM starts s JOIN placed p ON p.piece_id = s.piece_id AND p.part = s.part
       AND p.place >= s.from_place AND p.place < s.from_place + s.note_count),
listed AS (SELECT piece_id, index, string_agg(note_id, ',' ORDER BY part_order, place) AS note_ids
           FROM hits GROUP BY piece_id, index),
parts AS (SELECT piece_id, index, string_agg(part, ',' ORDER BY part_order) AS matched_parts
          FROM (SELECT DISTINCT piece_id, index, part, part_order FROM hits) GROUP BY piece_id, index)
"""

SPAN_NOTES = """
SELECT piece_id, index, part, place - 1 AS place, note_id AS note_ids FROM hits
"""

RESOLVED_SPANS = """
SELECT piece_id, index, coalesce(matched_parts, '') AS matched_parts, coalesce(note_ids, '') AS note_ids
FROM spans LEFT JOIN listed USING (piece_id, index) LEFT JOIN parts USING (piece_id, index)
"""

# Sonorities -----------------------------------------------------------------


def sonorities(compound: bool = True, sort: bool = False) -> str:
    token = quality("l.midi", "l.dpos", "c.midi", "c.dpos")
    if not compound:
        token = token.replace("abs(c.dpos - l.dpos) + 1) END", "abs(c.dpos - l.dpos) % 7 + 1) END")
    order = "l.midi - c.midi, c.part" if sort else "c.part"
    return f""",
points AS (SELECT DISTINCT piece_id, onset_ppq AS t, measure, beat FROM note_events),
covers AS (SELECT p.piece_id, p.t, n.part, n.midi, n.dpos, n.onset_ppq AS since
           FROM points p JOIN note_events n ON n.piece_id = p.piece_id AND n.onset_ppq <= p.t AND p.t < n.end_ppq
           WHERE n.midi IS NOT NULL),
lowest AS (SELECT * FROM covers QUALIFY row_number() OVER (PARTITION BY piece_id, t ORDER BY midi, part DESC) = 1),
stacks AS (SELECT c.piece_id, c.t, string_agg({token}, '/' ORDER BY {order}) AS sonority
           FROM covers c JOIN lowest l ON l.piece_id = c.piece_id AND l.t = c.t AND l.part <> c.part
           GROUP BY c.piece_id, c.t),
sonorities AS (
  SELECT p.piece_id, p.t AS onset_ppq, p.measure, p.beat, l.midi AS low_midi, l.dpos AS low_dpos,
         coalesce(l.part, 0) AS low_part, coalesce(l.since, -1) AS low_since, coalesce(s.sonority, '') AS sonority
  FROM points p LEFT JOIN lowest l USING (piece_id, t) LEFT JOIN stacks s USING (piece_id, t))
"""


SONORITY_ROWS = "SELECT piece_id, onset_ppq, measure, beat, low_midi, low_part, sonority FROM sonorities"

LOW_LINE = f""",
moved AS (
  SELECT *, lag(low_since) OVER w IS NULL OR lag(low_since) OVER w <> low_since
            OR lag(low_part) OVER w <> low_part AS moves,
         (SELECT max(end_ppq) FROM note_events n WHERE n.piece_id = s.piece_id) AS end_ppq
  FROM sonorities s WINDOW w AS (PARTITION BY piece_id ORDER BY onset_ppq)),
ahead AS (
  SELECT *, first_value(CASE WHEN moves THEN coalesce(low_midi, -1) END IGNORE NULLS) OVER w AS next_midi,
         first_value(CASE WHEN moves THEN coalesce(low_dpos, -1) END IGNORE NULLS) OVER w AS next_dpos
  FROM moved WINDOW w AS (PARTITION BY piece_id ORDER BY onset_ppq
                          ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
stepped AS (
  SELECT *, CASE WHEN NOT moves OR low_midi IS NULL OR next_midi IS NULL THEN 'Held'
                 WHEN next_midi = -1 THEN 'Rest'
                 ELSE {quality('low_midi', 'low_dpos', 'next_midi', 'next_dpos')} END AS low_line,
         CASE WHEN beat = 1 THEN 1.0::DOUBLE WHEN beat = 3 THEN 0.5::DOUBLE
              WHEN beat = floor(beat) THEN 0.25::DOUBLE
              WHEN beat * 2 = floor(beat * 2) THEN 0.125::DOUBLE
              WHEN beat * 4 = floor(beat * 4) THEN 0.0625::DOUBLE ELSE 0.03125::DOUBLE END AS strength
  FROM ahead),
items AS (SELECT *, low_line || '_' || sonority AS item FROM stepped)
"""

LOW_LINE_ROWS = "SELECT piece_id, onset_ppq, low_line, sonority, item FROM items"


def sonority_ngrams(n: int, where: str = "true") -> str:
    pattern = " || '_' || ".join(["item", *[f"lead(item, {k}) OVER w" for k in range(1, n)]])
    return f""",
grams AS (
  SELECT * FROM (
    SELECT *, {pattern} AS pattern_string, onset_ppq / 480.0::DOUBLE AS start_q,
           greatest(0.0::DOUBLE, least(1.0::DOUBLE, onset_ppq / CAST(end_ppq AS DOUBLE))) AS progress
    FROM items WHERE sonority <> '' AND ({where}) WINDOW w AS (PARTITION BY piece_id ORDER BY onset_ppq))
  WHERE pattern_string IS NOT NULL)
"""


GRAM_ROWS = "SELECT piece_id, measure, beat, onset_ppq, start_q, progress, pattern_string FROM grams"

INTRODUCED = """,
stats AS (SELECT piece_id, score_index, pattern_string, count(*) AS count, min(progress) AS first_progress
          FROM grams JOIN metadata USING (piece_id) GROUP BY ALL),
introduced AS (SELECT * FROM stats QUALIFY score_index = min(score_index) OVER (PARTITION BY pattern_string))
"""

INTRODUCED_ROWS = """
SELECT score_index, piece_id, concat_ws('::', piece_id, pattern_string) AS row_id, pattern_string, count, first_progress
FROM introduced
"""

INTRODUCED_OCCURRENCES = """
SELECT score_index, piece_id, concat_ws('::', piece_id, pattern_string) AS row_id,
       concat_ws('::', piece_id, pattern_string, CAST(start_q AS VARCHAR)) AS id, pattern_string, measure, beat,
       start_q, progress, count AS count_in_score
FROM grams JOIN introduced USING (piece_id, pattern_string)
"""

SCORE_FACTS = """
SELECT score_index, piece_id, count(DISTINCT pattern_string) AS pattern_count, max(start_q) AS end_q
FROM grams JOIN metadata USING (piece_id) GROUP BY ALL
"""

SONORITY_SUMMARY = """
SELECT (SELECT count(*) FROM introduced) AS pattern_count,
       (SELECT count(DISTINCT score_index) FROM introduced) AS score_count,
       count(*) AS occurrence_count, min(progress) AS first_progress, max(progress) AS last_progress
FROM grams JOIN introduced USING (piece_id, pattern_string)
"""

MOST_RECURRING = """
SELECT pattern_string, count, first_progress FROM introduced ORDER BY count DESC, first_progress, pattern_string LIMIT 5
"""

# Cadences -------------------------------------------------------------------


def _number(m0: str, d0: str, m1: str, d1: str) -> str:
    return f"(CASE WHEN {d1} >= {d0} THEN ({d1} - {d0}) % 7 + 1 ELSE -(({d0} - {d1}) % 7 + 1) END)"


def _step(d0: str, d1: str) -> str:
    return f"(CASE WHEN {d1} >= {d0} THEN {d1} - {d0} + 1 ELSE {d1} - {d0} - 1 END)"


CADENCES = f""",
near AS (
  SELECT *, lead(midi) OVER w AS nm, lead(dpos) OVER w AS nd, lag(midi) OVER w AS pm, lag(dpos) OVER w AS pd,
         lead(measure) OVER w AS nmeasure, lead(beat) OVER w AS nbeat
  FROM note_events WINDOW w AS (PARTITION BY piece_id, part ORDER BY seq)),
pairs AS (
  SELECT l.piece_id, l.part AS low_part, h.part AS high_part, l.end_ppq AS onset_ppq, l.nmeasure AS measure,
         l.nbeat AS beat, {_step('l.dpos', 'l.nd')} AS low_step,
         {_number('', 'l.dpos', '', 'h.dpos')} AS number,
         CASE WHEN h.end_ppq = l.end_ppq THEN h.nm ELSE h.midi END AS gm,
         CASE WHEN h.end_ppq = l.end_ppq THEN h.nd ELSE h.dpos END AS gd, h.dpos AS hd, l.nd AS lnd, l.nm AS lnm,
         l.nm - l.midi = -1 AND ((h.midi - l.midi) % 12 + 12) % 12 = 9 AS phrygian,
         CASE WHEN h.onset_ppq > l.onset_ppq AND h.pd - h.dpos = 1
              THEN {_number('', 'l.dpos', '', 'h.pd')} END AS held_high,
         CASE WHEN l.onset_ppq > h.onset_ppq AND l.pd - l.dpos = 1
              THEN {_number('', 'l.pd', '', 'h.dpos')} END AS held_low
  FROM near l JOIN near h ON l.piece_id = h.piece_id AND l.part > h.part
       AND l.onset_ppq < h.end_ppq AND h.onset_ppq < l.end_ppq
  WHERE l.midi IS NOT NULL AND h.midi IS NOT NULL AND l.nmeasure IS NOT NULL AND l.end_ppq <= h.end_ppq),
solved AS (SELECT *, coalesce({_number('', 'lnd', '', 'gd')} = 1 AND gd IS NOT NULL, false) AS reached,
                  CASE WHEN gd IS NOT NULL THEN {_step('hd', 'gd')} END AS high_step,
                  CASE WHEN gm IS NULL OR lnm < gm THEN lnm ELSE gm END AS tone_midi FROM pairs),
formulas AS (
  SELECT *, 1 AS rank, 'Authentic' AS cad_type, 'B' AS low_function, 'Ct' AS high_function FROM solved
    WHERE reached AND low_step IN (4, -5) AND number = 3 AND high_step = 2
  UNION ALL
  SELECT *, 2, 'Phrygian', 'T', 'Ct' FROM solved
    WHERE reached AND low_step = -2 AND number = 6 AND high_step = 2 AND phrygian
  UNION ALL
  SELECT *, 3, 'Clausula Vera', 'T', 'Ct' FROM solved
    WHERE reached AND low_step = -2 AND number = 6 AND high_step = 2 AND NOT phrygian
  UNION ALL
  SELECT *, 4, 'Clausula Vera', 'Ct', 'T' FROM solved
    WHERE reached AND low_step = 2 AND number = 3 AND high_step = -2
  UNION ALL
  SELECT *, 5, 'Plagal', 'B', 'Ct' FROM solved
    WHERE reached AND low_step IN (5, -4) AND number = 5 AND high_step = 1
  UNION ALL
  SELECT *, 9, 'Evaded', CASE WHEN number = 6 THEN 'T' WHEN held_high = 4 THEN 'B' ELSE 'Ct' END,
         CASE WHEN number = 6 OR held_high = 4 THEN 'Ct' ELSE 'T' END FROM solved
    WHERE NOT reached AND (((low_step IN (4, -5) OR lnm IS NULL) AND number = 3 AND held_high = 4)
       OR ((low_step = -2 OR lnm IS NULL) AND number = 6 AND held_high = 7)
       OR ((low_step = 2 OR lnm IS NULL) AND number = 3 AND held_low = 2))),
voices AS (SELECT piece_id, onset_ppq, low_part AS part, low_function AS function FROM formulas
           UNION SELECT piece_id, onset_ppq, high_part, high_function FROM formulas),
cadences AS (
  SELECT f.piece_id, f.onset_ppq, min(f.measure) AS measure, min(f.beat) AS beat, arg_min(f.cad_type, f.rank) AS cad_type,
         {CHROMATIC}[min(f.tone_midi) % 12 + 1] AS tone,
         (SELECT string_agg(function, ',' ORDER BY part, function) FROM voices v
          WHERE v.piece_id = f.piece_id AND v.onset_ppq = f.onset_ppq) AS cvfs
  FROM formulas f GROUP BY f.piece_id, f.onset_ppq)
"""

CADENCE_ROWS = """
SELECT c.piece_id, composer, title, measure, beat, onset_ppq, onset_ppq / CAST(e.end_ppq AS DOUBLE) AS progress,
       cad_type, tone, cvfs
FROM cadences c JOIN metadata USING (piece_id)
JOIN (SELECT piece_id, max(end_ppq) AS end_ppq FROM note_events GROUP BY piece_id) e USING (piece_id)
"""

# Excerpts -------------------------------------------------------------------

EXCERPT = """
SELECT piece_id, part, onset_ppq, midi, CASE WHEN v % 128 = 0 THEN 64 ELSE CAST(v % 128 AS INTEGER) END AS velocity,
       round((onset_ppq / 480.0::DOUBLE - 8.5) * 60.0 / 96, 9) AS at_sec,
       round(dur_ppq / 480.0::DOUBLE * 60.0 / 96, 9) AS for_sec
FROM note_events WHERE midi IS NOT NULL AND onset_ppq / 480.0::DOUBLE >= 8.5 AND onset_ppq / 480.0::DOUBLE < 40.25
"""

EXCERPT_BOUNDS = """
SELECT piece_id, 8.5::DOUBLE * 60 / 96 AS start_sec, least(40.25::DOUBLE * 60 / 96, end_q * 60 / 96) AS end_sec,
       least(40.25::DOUBLE * 60 / 96, end_q * 60 / 96) - 8.5::DOUBLE * 60 / 96 AS duration_sec
FROM (SELECT piece_id, max(end_ppq) / 480.0::DOUBLE AS end_q FROM note_events GROUP BY piece_id)
"""

MEASURE_RANGE = """
SELECT piece_id, part, seq, measure, onset_ppq, midi FROM note_events WHERE measure BETWEEN 5 AND 12
"""

# Profile --------------------------------------------------------------------


def most_common(table: str, column: str, alias: str, where: str = "true") -> str:
    return f"""
  SELECT piece_id, {column} AS {alias}, n AS {alias}_count
  FROM (SELECT piece_id, {column}, count(*) AS n FROM ({table}) WHERE {where} GROUP BY piece_id, {column})
  QUALIFY row_number() OVER (PARTITION BY piece_id ORDER BY n DESC, {column}) = 1"""

PROFILE = f""",
harmonic AS ({HARMONIC}),
top_ngram AS ({most_common('SELECT * FROM ngrams', 'pattern_string', 'top_pattern')}),
top_harmony AS ({most_common('SELECT * FROM harmonic', 'value', 'top_harmony', "value <> 'Rest'")}),
closes AS (SELECT piece_id, count(DISTINCT onset_ppq) AS cadences FROM formulas GROUP BY piece_id)
SELECT s.piece_id, notes, parts, title, composer, key_name, confidence, top_pattern, top_pattern_count,
       top_harmony, top_harmony_count, coalesce(cadences, 0) AS cadences
FROM (SELECT piece_id, count(midi) AS notes, count(DISTINCT part) AS parts FROM note_events GROUP BY piece_id) s
LEFT JOIN metadata USING (piece_id) LEFT JOIN keys USING (piece_id) LEFT JOIN top_ngram USING (piece_id)
LEFT JOIN top_harmony USING (piece_id) LEFT JOIN closes USING (piece_id)
"""

# Repeats --------------------------------------------------------------------

MEASURES = """
WITH measures AS (
  SELECT concat('o', o_custkey % 10) AS piece_id, o_orderkey // 4000 + 1 AS section_seq, o_orderkey AS measure_seq,
         CAST(o_orderkey AS DOUBLE) AS n,
         o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AS opens,
         o_orderpriority = '5-LOW' AND o_orderstatus = 'F' AS closes,
         o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' AS ending,
         CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 1 END AS ending_pass,
         o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' AND o_totalprice > 250000 AS after_other
  FROM orders)
"""

# A region is an rptend with an rptstart since the rptend before it; endings that
# follow directly are part of it.
PERFORMED = """,
closing AS (
  SELECT piece_id, section_seq, measure_seq AS e,
         coalesce(lag(measure_seq) OVER (PARTITION BY piece_id, section_seq ORDER BY measure_seq), -1) AS before
  FROM measures WHERE closes),
regions AS (
  SELECT c.piece_id, c.section_seq, c.e, min(m.measure_seq) AS s,
         (SELECT min(x.measure_seq) FROM measures x WHERE x.piece_id = c.piece_id AND x.section_seq = c.section_seq
          AND x.measure_seq > c.e AND (NOT x.ending OR x.after_other)) AS stop
  FROM closing c JOIN measures m ON m.piece_id = c.piece_id AND m.section_seq = c.section_seq AND m.opens
       AND m.measure_seq > c.before AND m.measure_seq <= c.e
  GROUP BY c.piece_id, c.section_seq, c.e),
inside AS (
  SELECT m.*, r.s AS region,
         max(CASE WHEN m.ending AND m.measure_seq % 4 <> 2 THEN 1 ELSE 0 END) OVER (PARTITION BY m.piece_id, m.section_seq, r.s) AS numbered,
         last_value(CASE WHEN m.ending THEN m.ending_pass END IGNORE NULLS) OVER (
           PARTITION BY m.piece_id, m.section_seq, r.s ORDER BY m.measure_seq) AS in_force
  FROM measures m JOIN regions r ON m.piece_id = r.piece_id AND m.section_seq = r.section_seq AND m.measure_seq >= r.s
       AND (m.measure_seq <= r.e OR (m.ending AND m.measure_seq < coalesce(r.stop, 9e18)))),
played AS (
  SELECT piece_id, measure_seq, n, region, stage FROM inside, (VALUES (10), (20)) v(stage)
  WHERE numbered = 0 OR (NOT ending AND in_force IS NULL)
  UNION ALL
  SELECT piece_id, measure_seq, n, region, in_force * 10 + 1 FROM inside
  WHERE numbered = 1 AND in_force IS NOT NULL AND (NOT ending OR ending_pass IS NOT NULL)
  UNION ALL
  SELECT piece_id, measure_seq, n, measure_seq, 10 FROM measures m
  WHERE NOT ending AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.piece_id = m.piece_id AND i.measure_seq = m.measure_seq)),
performed AS (
  SELECT piece_id, row_number() OVER (PARTITION BY piece_id ORDER BY region, stage, measure_seq) AS performed_seq,
         measure_seq, n, CAST(stage // 10 AS INTEGER) AS pass
  FROM played)
"""

EVENT_MEASURES = """,
measures AS (
  SELECT DISTINCT piece_id, 1 AS section_seq, onset_ppq // 1920 + 1 AS measure_seq,
         CAST(onset_ppq // 1920 + 1 AS DOUBLE) AS n, (onset_ppq // 1920 + 1) % 8 = 3 AS opens,
         (onset_ppq // 1920 + 1) % 8 = 6 AS closes, false AS ending, CAST(NULL AS INTEGER) AS ending_pass, false AS after_other
  FROM note_events)
"""

# Every bar has 1,920 ticks, whatever is held over it.
PERFORMED_EVENTS = """
SELECT e.piece_id, part, seq, performed_seq, CAST((performed_seq - 1) * 1920 + onset_ppq % 1920 AS BIGINT) AS onset_ppq
FROM note_events e JOIN performed l ON l.piece_id = e.piece_id AND l.measure_seq = e.onset_ppq // 1920 + 1
"""

# Documents ------------------------------------------------------------------

DOCUMENTS = """
WITH docs AS (
  SELECT *, concat('order_', o_orderkey, '.mei') AS piece_id,
         CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 'root'
              WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F' THEN 'code'
              WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'cut' ELSE 'good' END AS state
  FROM orders)
"""

DOCUMENT_STATES = """
SELECT piece_id, state = 'good' AS is_valid,
       CASE state WHEN 'root' THEN 'not a score' WHEN 'code' THEN 'unreadable' WHEN 'cut' THEN 'not well-formed XML' END AS error
FROM docs
"""

DOCUMENT_METADATA = """
SELECT piece_id, concat('Order ', o_orderkey) AS title, concat('Customer ', o_custkey) AS composer,
       o_orderpriority AS analysts, strftime(o_orderdate, '%Y-%m-%d') AS publication_date,
       CAST(o_orderdate AS DATE) AS published
FROM docs WHERE state = 'good'
"""

# Four measures of 3/4, as long as their longest voice; staves in order of appearance; ties in the third.
DOCUMENT_NOTES = """,
lines AS (
  SELECT d.piece_id, 1 + (l_linenumber - 1) // 2 AS measure_seq,
         CASE WHEN l_suppkey % 5 = 0 THEN 3 ELSE 1 + l_linenumber % 2 END AS staff_no, l_partkey, l_suppkey, l_linenumber,
         CAST(l_quantity AS BIGINT) AS q
  FROM docs d JOIN lineitem ON l_orderkey = o_orderkey WHERE state = 'good'),
staves AS (
  SELECT piece_id, staff_no, row_number() OVER (PARTITION BY piece_id ORDER BY min(measure_seq * 10 + staff_no)) AS part
  FROM lines GROUP BY piece_id, staff_no),
timed AS (
  SELECT lines.*, part, CAST([960, 480, 360, 120][q % 4 + 1] AS BIGINT) AS ticks,
         CASE WHEN q % 11 = 0 THEN NULL WHEN staff_no = 3 THEN 84
              ELSE 12 * (4 + q % 3) + [0,2,4,5,7,9,11][l_partkey % 7 + 1] + [0,1,-1,-2][l_suppkey % 4 + 1] END AS midi,
         CASE WHEN q % 11 = 0 THEN NULL WHEN staff_no = 3 THEN 42 ELSE 7 * (3 + q % 3) + l_partkey % 7 END AS dpos,
         CASE WHEN q % 11 <> 0 THEN concat('n', l_partkey, '-', l_suppkey, '-', l_linenumber) END AS id
  FROM lines JOIN staves USING (piece_id, staff_no)),
voices AS (SELECT piece_id, measure_seq, part, sum(ticks) AS ticks FROM timed GROUP BY ALL),
timeline AS (
  SELECT piece_id, measure_seq, CAST(coalesce(ticks, 1440) AS BIGINT) AS length_ppq,
         CAST(coalesce(sum(coalesce(ticks, 1440)) OVER (PARTITION BY piece_id ORDER BY measure_seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ppq
  FROM (SELECT piece_id, m AS measure_seq FROM docs, range(1, 5) r(m) WHERE state = 'good')
  LEFT JOIN (SELECT piece_id, measure_seq, max(ticks) AS ticks FROM voices GROUP BY ALL) USING (piece_id, measure_seq)),
placed AS (
  SELECT *, coalesce(sum(ticks) OVER (PARTITION BY piece_id, part, measure_seq ORDER BY l_partkey, l_suppkey, l_linenumber
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside,
         row_number() OVER w AS place,
         NOT coalesce(staff_no = 3 AND midi = lag(midi) OVER w, false) AS head
  FROM timed WINDOW w AS (PARTITION BY piece_id, part ORDER BY measure_seq, l_partkey, l_suppkey, l_linenumber)),
numbered AS (
  SELECT *, sum(head::INT) OVER (PARTITION BY piece_id, part ORDER BY place) AS seq FROM placed),
merged AS (
  SELECT piece_id, part, CAST(seq AS BIGINT) AS seq, CAST(sum(ticks) AS BIGINT) AS dur_ppq, min(measure_seq) AS measure_seq,
         arg_min(inside, place) AS inside, CAST(any_value(staff_no) AS VARCHAR) AS staff, arg_min(midi, place) AS midi,
         arg_min(dpos, place) AS dpos, string_agg(id, ',' ORDER BY place) AS note_ids
  FROM numbered GROUP BY piece_id, part, seq),
note_events AS (
  SELECT piece_id, CAST(part AS INTEGER) AS part, staff, seq, measure_seq, CAST(start_ppq + inside AS BIGINT) AS onset_ppq, dur_ppq,
         CAST(start_ppq + inside + dur_ppq AS BIGINT) AS end_ppq, CAST(6 + measure_seq AS DOUBLE) AS measure,
         1 + inside / 480.0 AS beat, inside, CAST(midi AS INTEGER) AS midi, CAST(dpos AS INTEGER) AS dpos, note_ids
  FROM merged JOIN timeline USING (piece_id, measure_seq))
"""

DOCUMENT_EVENTS = """
SELECT piece_id, part, staff, seq, onset_ppq, dur_ppq, measure, midi, dpos, note_ids FROM note_events
"""

MEASURE_TIMELINE = "SELECT piece_id, measure_seq, start_ppq, length_ppq FROM timeline"

# The second and third measure are played twice.
DOCUMENT_PERFORMED = """,
walk AS (SELECT * FROM (VALUES (1, 1), (2, 2), (3, 3), (4, 2), (5, 3), (6, 4)) v(performed_seq, measure_seq)),
laid AS (
  SELECT piece_id, performed_seq, measure_seq,
         coalesce(sum(length_ppq) OVER (PARTITION BY piece_id ORDER BY performed_seq
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM timeline JOIN walk USING (measure_seq))
SELECT piece_id, part, seq, performed_seq, CAST(start + inside AS BIGINT) AS onset_ppq
FROM note_events JOIN laid USING (piece_id, measure_seq)
"""

NOTES_WIDE = """
SELECT piece_id, measure, beat, onset_ppq, max(CASE WHEN part = 1 THEN token END) AS p1,
       max(CASE WHEN part = 2 THEN token END) AS p2, max(CASE WHEN part = 3 THEN token END) AS p3,
       max(CASE WHEN part = 4 THEN token END) AS p4, max(CASE WHEN part = 5 THEN token END) AS p5
FROM (""" + NOTE_TABLE + """) GROUP BY piece_id, measure, beat, onset_ppq
"""

NOTES_LONG = """
SELECT piece_id, measure, beat, onset_ppq, 'p' || part AS part, token
FROM (""" + NOTE_TABLE + """) WHERE token IS NOT NULL
"""

# Written cells by what they are made of: letter, accidental and octave.
TOKENS = """
WITH cells AS (
  SELECT 'l' || l_orderkey % 100 AS piece_id, CAST(l_linenumber AS INTEGER) AS part, l_partkey % 9 AS letter,
         l_suppkey % 4 AS mark, CAST(l_quantity AS BIGINT) % 8 AS octave
  FROM lineitem WHERE l_partkey % 31 <> 0 AND l_partkey % 9 <> 8),
judged AS (
  SELECT *, CASE WHEN letter = 7 THEN 'unknown letter' WHEN octave = 6 THEN 'no octave'
                 WHEN mark = 3 THEN 'unknown accidental' WHEN octave = 7 THEN 'octave out of range' END AS reason
  FROM cells)
"""

TOKEN_RANGES = f"""
, heights AS (
  SELECT piece_id, part, CAST(12 + octave * 12 + [0, 2, 4, 5, 7, 9, 11][letter + 1] + [0, 1, -1][mark + 1] AS INTEGER) AS midi
  FROM judged WHERE reason IS NULL),
ends AS (SELECT piece_id, part, min(midi) AS lowest_midi, max(midi) AS highest_midi FROM heights GROUP BY piece_id, part)
SELECT *, {CHROMATIC}[lowest_midi % 12 + 1] || CAST(lowest_midi // 12 - 1 AS VARCHAR) AS lowest_note,
       {CHROMATIC}[highest_midi % 12 + 1] || CAST(highest_midi // 12 - 1 AS VARCHAR) AS highest_note,
       highest_midi - lowest_midi AS range_semitones
FROM ends
"""

UNREADABLE_TOKENS = """
SELECT piece_id, part, ' ' || ['C','D','E','F','G','A','B','H'][letter + 1] || ['', '#', '-', 'x'][mark + 1]
         || ['0','1','2','3','4','5','','4000000000'][octave + 1] AS token, reason, count(*) AS times
FROM judged WHERE reason IS NOT NULL GROUP BY ALL
"""

# Catalogue ------------------------------------------------------------------

SCORES = """
WITH scores AS (
  SELECT concat(['Bach','Bartok','Morley','CRIM','Other'][doc_id % 5 + 1], '_', doc_id // 5, '.mei') AS filename,
         concat('/scores/', doc_id) AS path, 'builtin' AS source, doc_id AS registered_at FROM documents
  UNION ALL
  SELECT concat(['Bach','Bartok','Morley','CRIM','Other'][doc_id % 5 + 1], '_', doc_id // 7, '.mei'),
         concat('/inbox/', doc_id), 'registered', doc_id FROM documents)
"""

COLLECTIONS = """,
listed AS (
  SELECT DISTINCT CASE WHEN filename LIKE 'Bach%' THEN 'bach_inventions' WHEN filename LIKE 'Bartok%' THEN 'bartok_mikrokosmos'
                       WHEN filename LIKE 'Morley%' THEN 'morley_canzonets' WHEN filename LIKE 'CRIM%' THEN 'crim_corpus' END
         AS collection, filename FROM scores WHERE source = 'builtin'
  UNION SELECT 'uploaded_mei_files', filename FROM scores WHERE source = 'registered'
  UNION SELECT 'all_files', filename FROM scores)
"""

RESOLVED = """
SELECT filename, source, path FROM scores
QUALIFY row_number() OVER (PARTITION BY filename ORDER BY source = 'registered' DESC, registered_at DESC, path DESC) = 1
"""

UNREGISTERED = """
SELECT filename, path, source FROM scores s
WHERE source = 'builtin' OR NOT EXISTS (
  SELECT 1 FROM (SELECT concat(['Bach','Bartok','Morley','CRIM','Other'][item_id % 5 + 1], '_', item_id, '.mei') AS filename
                 FROM benchmark) b WHERE b.filename = s.filename)
"""

NAME_ERRORS = """
SELECT page_id, CASE WHEN trim(name) = '' THEN 'a score needs a file name'
            WHEN contains(name, '/') OR contains(name, chr(92)) OR trim(name) IN ('.', '..')
              THEN 'the file name may not be a path'
            WHEN NOT ends_with(lower(trim(name)), '.mei') THEN 'the file name lacks the ending .mei' END AS error
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat(split_part(url, '/', -1), '.MEI')
                      WHEN 2 THEN split_part(url, '/', -1) ELSE '  ' END AS name FROM pages)
"""

PIECE_LIST = """
SELECT source AS piece_id, row_number() OVER (ORDER BY min(doc_id)) - 1 AS score_index
FROM documents WHERE source <> '' GROUP BY source
"""

# Scalar functions -----------------------------------------------------------

SPELLED = """
SELECT p_partkey, pname, accid,
       CAST(CASE WHEN accid IN ('n', '', 'q') THEN 0 WHEN accid IN ('s', 'ss', 'sss') THEN length(accid)
            WHEN accid = 'x' THEN 2 WHEN accid = 'xs' THEN 3 WHEN accid = 'tf' THEN -3 ELSE -length(accid) END AS INTEGER) AS semitones,
       CAST(((CASE pname WHEN 'c' THEN 0 WHEN 'd' THEN 2 WHEN 'e' THEN 4 WHEN 'f' THEN 5 WHEN 'g' THEN 7 WHEN 'a' THEN 9
        ELSE 11 END + CASE WHEN accid IN ('n', '', 'q') THEN 0 WHEN accid IN ('s', 'ss', 'sss') THEN length(accid)
            WHEN accid = 'x' THEN 2 WHEN accid = 'xs' THEN 3 WHEN accid = 'tf' THEN -3 ELSE -length(accid) END) % 12 + 12) % 12
        AS INTEGER) AS pc
FROM (SELECT p_partkey, ['c','d','e','f','g','a','b'][p_partkey % 7 + 1] AS pname,
             ['n','s','ss','x','xs','f','ff','tf','sss','ffff','','q'][p_size % 12 + 1] AS accid FROM part)
"""

PATTERN_KEYS = """
SELECT p_partkey, array_to_string([trim(x) FOR x IN
         CASE WHEN contains(text, '_') THEN string_split(text, '_') ELSE string_split(text, ',') END IF trim(x) <> ''], '_')
         AS pattern_key,
       array_to_string([trim(x) FOR x IN
         CASE WHEN contains(text, ',') THEN string_split(text, ',') ELSE string_split(text, '_') END IF trim(x) <> ''], '_')
         AS module_key,
       array_to_string([trim(x) FOR x IN string_split_regex(labels, '::|[-,/_]') IF trim(x) <> ''], '|') AS parts
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '__') WHEN 1 THEN replace(p_name, ' ', ', ,')
                        ELSE concat(replace(p_name, ' ', '_'), ',', p_size) END AS text,
             concat(p_size, ['::', '-', ' , ', '/', '_'][p_partkey % 5 + 1], p_partkey % 9) AS labels FROM part)
"""

# Ties -----------------------------------------------------------------------

TIES = """,
heads AS (
  SELECT *, coalesce(lag(midi) OVER w = midi AND seq % 3 = 0, false) AS tied
  FROM note_events WINDOW w AS (PARTITION BY piece_id, part ORDER BY seq)),
chains AS (SELECT *, sum(CASE WHEN tied THEN 0 ELSE 1 END) OVER (PARTITION BY piece_id, part ORDER BY seq) AS chain FROM heads),
joined AS (
  SELECT piece_id, part, CAST(chain AS BIGINT) AS seq, min(onset_ppq) AS onset_ppq, CAST(sum(dur_ppq) AS BIGINT) AS dur_ppq,
         min(midi) AS midi, coalesce(string_agg(note_id, ',' ORDER BY seq) FILTER (WHERE midi IS NOT NULL), '') AS note_ids
  FROM chains GROUP BY piece_id, part, chain)
SELECT *, CASE WHEN midi IS NOT NULL THEN count(midi) OVER (PARTITION BY piece_id, part ORDER BY seq) - 1 END AS note_place
FROM joined
"""
