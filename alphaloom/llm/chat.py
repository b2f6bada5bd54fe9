"""Chat formatting by perspective rotation: one training dialogue per participant.

For every participant of a conversation the whole dialogue is rendered with that speaker as
"assistant" and all others as named users; the mask marks the characters that the model is to learn,
those of the participant's own turns. Speakers who only set the scene (SCENE) stay "system" in every
view and get none of their own.

Output is one row per view and turn, so a conversation of any length is never gathered: ``views``
are joined to turns. Positions are counted within ranges of the turns' order and character offsets within
chunks of CHUNK positions, and prefix sums over ranges and chunks are added, so a conversation that holds a
third of all rows is spread over many tasks (only turns equal in turn, role and the text's first 32 characters
stay in one range). A speaker
is a participant once, however many turns they have; only the number of participants multiplies rows,
which is what the format asks for. ``dialogues`` joins the rows of each view into one text with spans.

Nobody can write a marker: in a content a backslash goes between "<" and "|" (and one more where there are
some already), so it can be taken away again, and in names "%", "|", "<", ">" and white space are
percent-encoded, so different speakers have different names.

Defined cases: a null role is the speaker "unknown"; a null text is an empty turn; turns are ordered by
turn, then role and text (repeated rows stay, in that order), null turns first; a null conv_id is one
conversation of its own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.llm.common import prepare, table, written

SCENE = ["system"]
#: Turns of a conversation that one task sorts and sums at once.
CHUNK = 10_000
_SPECIAL = "%|<> \t\n\x0b\f\r"


def _plain_name(name: Column) -> Column:
    for c in _SPECIAL:
        name = F.replace(name, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return name


def _before(key: list[str], order: str, value: str) -> Column:
    """The sum of ``value`` over the key's earlier rows."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _positions(spark: SparkSession, base: DataFrame) -> DataFrame:
    """``base`` with the position of each turn in its conversation, and the chunk of positions it lies in."""
    # ranges of the turns' order, written, so that every reader sees the same ones; a long conversation lies in many
    ranges = base.repartitionByRange("key", "turn", "speaker", F.substring("content", 1, 32)).withColumn("part", F.spark_partition_id())
    ranges = written(spark, ranges, "ranges")
    counts = ranges.groupBy("key", "part").agg(F.count("*").alias("n"))
    # only the first conversation of a range can go on from an earlier one: a row per range at most
    earlier = counts.withColumn("earlier", _before(["key"], "part", "n")).where("earlier > 0").select("key", "part", "earlier")
    number = F.row_number().over(Window.partitionBy("key", "part").orderBy("turn", "speaker", "content"))
    out = ranges.withColumn("position", number).join(F.broadcast(earlier), ["key", "part"], "left")
    out = out.withColumn("position", (F.col("position") + F.coalesce("earlier", F.lit(0))).cast("int"))
    return out.select("key", "speaker", "content", "position", F.floor((F.col("position") - 1) / CHUNK).cast("int").alias("chunk"))


def _rendered(seen: DataFrame) -> DataFrame:
    """Turns as their view shows them, with the sizes of header and whole."""
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker").isin(SCENE), "system").otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    header = F.concat(F.lit("<|"), role, F.coalesce(F.concat(F.lit(" name="), _plain_name(name)), F.lit("")), F.lit("|>\n"))
    rendered = F.concat(header, F.regexp_replace("content", r"<(\\*)\|", r"<\\$1|"), F.lit("\n<|end|>\n"))
    return seen.withColumns({"role": role, "name": name, "rendered": rendered, "header": F.length(header), "size": F.length(rendered).cast("long"), "learn": own})


def rotate(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Per view and turn: conv_id, perspective, position, role, name, content, rendered, start, stop, learn.

    ``rendered`` is the turn's text in the view, start and stop its span in the whole dialogue (turns
    are joined without a separator), learn whether its content is to be learnt, content_start where
    the content begins.
    """
    prepare(spark)
    conversation = F.struct(F.col("conv_id").alias("id")).alias("key")
    base = turns.select(conversation, "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    placed = written(spark, _positions(spark, base), "turns")
    views = placed.where(~F.col("speaker").isin(SCENE)).select("key", F.col("speaker").alias("perspective")).distinct()
    rows = _rendered(placed.join(views, "key"))
    view = ["key", "perspective", "chunk"]
    stop = F.sum("size").over(Window.partitionBy(*view).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # what earlier chunks take, for conversations of several chunks only
    several = placed.where("chunk > 0").select("key").distinct()
    sizes = _rendered(placed.join(several, "key", "left_semi").join(views, "key")).groupBy(*view).agg(F.sum("size").alias("size"))
    earlier = sizes.withColumn("earlier", _before(["key", "perspective"], "chunk", "size")).where("earlier > 0").select(*view, "earlier")
    out = rows.withColumn("stop", stop).join(earlier, view, "left").withColumn("stop", F.col("stop") + F.coalesce("earlier", F.lit(0)))
    out = out.withColumn("start", F.col("stop") - F.col("size")).withColumn("content_start", F.col("start") + F.col("header"))
    return out.select(F.col("key.id").alias("conv_id"), "perspective", "position", "role", "name", "content", "rendered", "start", "stop", "content_start", "learn")


def dialogues(rotated: DataFrame) -> DataFrame:
    """Per view: conv_id, perspective, text, and mask, the learnt spans (content and end mark) in characters."""
    rows = rotated.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(F.struct("position", "rendered", "content_start", "stop", "learn"))).alias("t"))
    mask = F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["content_start"].alias("start"), x["stop"].alias("stop")))
    return rows.select("conv_id", "perspective", F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("text"), mask.alias("mask"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark, table(spark, sf_dir, "conversations"))


def chat_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole views of ``conversations``: conv_id, perspective, text, and mask as "start:stop" pairs joined by commas."""
    rows = dialogues(op9(spark, sf_dir))
    return rows.withColumn("mask", F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["stop"].cast("string"))), ","))


_NAME_SQL = "speaker"
for _c in _SPECIAL:
    _NAME_SQL = f"replace({_NAME_SQL}, chr({ord(_c)}), '%{ord(_c):02X}')"

_VIEWS_SQL = rf"""
WITH placed AS (
  SELECT conv_id, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS INTEGER) AS position
  FROM conversations),
views AS (SELECT DISTINCT conv_id, speaker AS perspective FROM placed WHERE speaker <> 'system'),
seen AS (
  SELECT p.conv_id, v.perspective, p.position, p.content, p.speaker = v.perspective AS learn, p.speaker,
         CASE WHEN p.speaker = v.perspective THEN 'assistant' WHEN p.speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM placed p JOIN views v ON p.conv_id IS NOT DISTINCT FROM v.conv_id),
headed AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
         '<|' || role || CASE WHEN role = 'user' THEN ' name=' || {_NAME_SQL} ELSE '' END || '|>' || chr(10) AS header
  FROM seen),
rendered AS (SELECT *, header || regexp_replace(content, '<(\\*)\|', '<\\\1|', 'g') || chr(10) || '<|end|>' || chr(10) AS rendered FROM headed),
ended AS (
  SELECT *, CAST(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY position ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM rendered),
rows_ AS (
  SELECT conv_id, perspective, position, role, name, content, rendered, stop - length(rendered) AS start, stop,
         stop - length(rendered) + length(header) AS content_start, learn
  FROM ended)
"""
#: DuckDB SQL for op9's rows, and for whole views.
OP9_SQL = _VIEWS_SQL + "SELECT * FROM rows_"
DIALOGUES_SQL = _VIEWS_SQL + """
SELECT conv_id, perspective, string_agg(rendered, '' ORDER BY position) AS text,
       coalesce(string_agg(content_start || ':' || stop, ',' ORDER BY position) FILTER (WHERE learn), '') AS mask
FROM rows_ GROUP BY conv_id, perspective
"""
