"""Rebuilding conversations from message rows with keyed streaming state.

The messages are a stream. State is kept for each session and slice of time: late messages are
buffered until the watermark has passed the slice and the allowed lateness, then the slice's messages
are put in order, checked and emitted as one segment, and the state is dropped. A session that never
ends, such as a shared kiosk, thus never gathers its rows in one state, row or task. Segments carry
what the joint with the next one needs, so a session is judged from narrow rows. Messages without a
time have no place in a slice; they pass by the state and count as what they are, a fault.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.session import exists, is_file, new_path

#: A message may come so much later than the newest one of the stream; length of a slice.
LATENESS, SLICE = timedelta(days=2), timedelta(minutes=15)

# Other spellings of the roles.
ROLE_NAMES = {"user": "user", "human": "user", "assistant": "assistant", "bot": "assistant", "ai": "assistant", "system": "system"}
#: Session of the marker that closes a finite stream.
CLOSING = "\u0000closing"
# Characters without width, blank as a text.
INVISIBLE = r"\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{AD}\x{180E}\x{202A}-\x{202E}"

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)
SEGMENT_SCHEMA = (
    "session_id string, slice timestamp, n_rows bigint, visible boolean, bad boolean, said string, "
    "turns array<struct<us:bigint,id:bigint,role:string,text:string>>"
)


def _span(length: timedelta) -> str:
    return f"{int(length.total_seconds())} seconds"


def told_messages(messages: DataFrame) -> DataFrame:
    """`id, session_id, role, text, shown, event_time` of messages (columns of MESSAGE_SCHEMA) that belong to a
    session: the role in one spelling (null if unknown), the text without outer spaces, and whether any of it shows."""
    text = F.regexp_replace("content", r"^[\s\x{A0}\x{3000}]+|[\s\x{A0}\x{3000}]+$", "")
    role = F.lower(F.regexp_replace("role", r"^[\s\x{A0}]+|[\s\x{A0}]+$", ""))
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return messages.where(F.length(F.regexp_replace("session_id", r"\s+", "")) > 0).select(
        F.coalesce("id", F.lit(-1).cast("bigint")).alias("id"), "session_id", F.try_element_at(names, role).alias("role"), text.alias("text"),
        F.coalesce(F.length(F.regexp_replace(text, rf"[\s\p{{Z}}{INVISIBLE}]+", "")) > 0, F.lit(False)).alias("shown"),
        F.col("created_at").cast("timestamp").alias("event_time"),
    )


def conversation_segments(messages: DataFrame, lateness: timedelta = LATENESS, slice_: timedelta = SLICE) -> DataFrame:
    """The stream of closed segments (SEGMENT_SCHEMA) of a stream of messages with a time.

    Turns are in order of time and id; system rows, rows without visible text and repeats of the row
    before are left out of them. `said` has one letter a turn: u for a user's, a for an assistant's.
    """
    rows = told_messages(messages).where("event_time is not null").withWatermark("event_time", _span(lateness))
    row = F.struct(F.unix_micros("event_time").alias("us"), "id", "role", "text", "shown")
    closed = rows.groupBy("session_id", F.window("event_time", _span(slice_)).alias("w")).agg(F.collect_list(row).alias("rows"))
    speaks = lambda r: r["shown"] & r["role"].isin("user", "assistant")
    closed = closed.select("session_id", F.col("w.start").alias("slice"), "rows", F.array_sort(F.filter("rows", speaks)).alias("spoken"))
    before = lambda i, key: F.get("spoken", i - 1)[key]
    same = lambda r, i: (r["role"] == before(i, "role")) & (r["text"] == before(i, "text"))
    turns = F.filter("spoken", lambda r, i: ~F.coalesce(same(r, i), F.lit(False)))
    turns = F.transform(turns, lambda r: F.struct(r["us"].alias("us"), r["id"].alias("id"), r["role"].alias("role"), r["text"].alias("text")))
    return closed.select(
        "session_id", "slice", F.size("rows").cast("bigint").alias("n_rows"), F.exists("rows", lambda r: r["shown"]).alias("visible"),
        F.exists("rows", lambda r: r["role"].isNull()).alias("bad"), turns.alias("turns"),
    ).select("session_id", "slice", "n_rows", "visible", "bad", F.array_join(F.transform("turns", lambda t: F.left(t["role"], F.lit(1))), "").alias("said"), "turns")


def untimed_segments(messages: DataFrame) -> DataFrame:
    """Each message without a time as a segment (SEGMENT_SCHEMA) of its own, without slice or turns."""
    rows = told_messages(messages).where("event_time is null")
    turns = F.array().cast("array<struct<us:bigint,id:bigint,role:string,text:string>>")
    return rows.select(
        "session_id", F.lit(None).cast("timestamp").alias("slice"), F.lit(1).cast("bigint").alias("n_rows"), F.col("shown").alias("visible"),
        F.lit(True).alias("bad"), F.lit("").alias("said"), turns.alias("turns"),
    )


def closed_segments(spark: SparkSession, path: str, base: str | None = None, lateness: timedelta = LATENESS, slice_: timedelta = SLICE) -> DataFrame:
    """All segments of the message files under `path`, each slice closed.

    The files run through the stream in one micro-batch, so that none of them is late for another;
    then a marker moves the watermark to the end of the last slice, and what is still buffered times
    out. Segments, state and progress are in `base` (a new place in the shared folder); a lost executor
    costs a micro-batch. Called again with the same `base`, only files that are new are read; a message
    for a slice that was closed then comes too late and is told by `late_messages`.
    """
    base = base or new_path(spark, "conversations")
    control = f"{base}/control"
    if not exists(spark, control):
        spark.createDataFrame([], MESSAGE_SCHEMA).write.parquet(control)

    def stream() -> DataFrame:
        reader = spark.readStream.schema(MESSAGE_SCHEMA)
        if is_file(spark, path):  # a stream reads folders
            folder, name = path.rsplit("/", 1)
            return reader.option("pathGlobFilter", name).parquet(folder)
        return reader.parquet(path)

    def run(rows: DataFrame, name: str) -> None:
        writer = rows.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint-{name}").outputMode("append")
        writer.trigger(availableNow=True).start(f"{base}/{name}").awaitTermination()

    def run_state() -> None:
        marker = spark.readStream.schema(MESSAGE_SCHEMA).parquet(control)
        run(conversation_segments(stream().unionByName(marker), lateness, slice_), "segments")

    run(untimed_segments(stream()), "untimed")
    run_state()
    last = spark.read.schema(MESSAGE_SCHEMA).parquet(path).agg(F.max("created_at")).first()[0]
    if last is not None:
        row = spark.createDataFrame([(0, CLOSING, "system", "", last + lateness + slice_)], MESSAGE_SCHEMA)
        row.coalesce(1).write.mode("append").parquet(control)
        run_state()
    read = lambda name: spark.read.schema(SEGMENT_SCHEMA).parquet(f"{base}/{name}")
    return read("segments").where(F.col("session_id") != CLOSING).unionByName(read("untimed"))


def late_messages(messages: DataFrame, segments: DataFrame, slice_: timedelta = SLICE) -> DataFrame:
    """`session_id, slice, n_late`: how many messages of a closed slice came too late for its segment."""
    rows = told_messages(messages).where("event_time is not null")
    rows = rows.groupBy("session_id", F.window("event_time", _span(slice_))["start"].alias("slice")).agg(F.count("*").alias("n"))
    known = segments.where("slice is not null").groupBy("session_id", "slice").agg(F.sum("n_rows").alias("n_rows"))
    late = F.col("n") - F.coalesce("n_rows", F.lit(0))
    return rows.join(known, ["session_id", "slice"], "left").select("session_id", "slice", late.alias("n_late")).where("n_late > 0")


def joined_segments(segments: DataFrame) -> DataFrame:
    """One narrow row a segment, without its turns: its flags, whether its first turn `repeats` the turn before
    it, how many turns are `before` it, and `said` with the letter of that turn in front."""
    key = lambda t: F.when(F.col("said") != "", F.xxhash64(t["role"], t["text"]))
    ends = [key(F.try_element_at("turns", F.lit(k))).alias(name) for k, name in ((1, "first"), (-1, "last"))]
    narrow = segments.select("session_id", "slice", "visible", "bad", "said", *ends)
    spoken = narrow.where("said != ''")
    order = W.partitionBy("session_id").orderBy("slice")
    spoken = spoken.withColumns(
        {"repeats": F.coalesce(F.lag("last").over(order) == F.col("first"), F.lit(False)), "previous": F.coalesce(F.right(F.lag("said").over(order), F.lit(1)), F.lit("^"))}
    )
    own = F.when(F.col("repeats"), F.expr("substring(said, 2)")).otherwise(F.col("said"))
    spoken = spoken.withColumn("said", F.concat("previous", own)).withColumn(
        "before", F.coalesce(F.sum(F.length("said") - 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    ends_here = F.lead("slice").over(order).isNull()
    spoken = spoken.withColumn("said", F.when(ends_here, F.concat("said", F.lit("$"))).otherwise(F.col("said")))
    return spoken.drop("previous").unionByName(narrow.where("said = ''"), allowMissingColumns=True)


def session_defects(segments: DataFrame) -> DataFrame:
    """`session_id, defect` of every session; the defect is null where the conversation is sound.

    empty: no row has visible text; broken: a row without a time or with an unknown role, an
    assistant first, or two replies in a row; missing_reply: a user row without a reply after it.
    """
    flags = joined_segments(segments).groupBy("session_id").agg(
        F.bool_or("visible").alias("visible"), F.bool_or(F.col("bad") | F.col("said").rlike(r"\^a|aa")).alias("broken"),
        F.bool_or(F.col("said").rlike(r"uu|u\$")).alias("unanswered"),
    )
    defect = F.when(~F.col("visible"), "empty").when(F.col("broken"), "broken").when(F.col("unanswered"), "missing_reply")
    return flags.select("session_id", defect.alias("defect"))


def conversations(segments: DataFrame) -> DataFrame:
    """`session_id, turn_no, role, content, id` of the turns of all sound conversations, in order.

    Turns are numbered by narrow rows of their segments and never gathered by session.
    """
    sound = session_defects(segments).where("defect is null").select("session_id")
    places = joined_segments(segments).where("first is not null").join(sound, "session_id", "left_semi").select("session_id", "slice", "repeats", "before")
    turns = segments.where("said != ''").join(places, ["session_id", "slice"])
    turns = turns.select("session_id", "repeats", "before", F.posexplode("turns").alias("pos", "turn")).where("not (repeats and pos = 0)")
    turn_no = F.col("before") + F.col("pos") + 1 - F.col("repeats").cast("int")
    return turns.select("session_id", turn_no.cast("bigint").alias("turn_no"), "turn.role", F.col("turn.text").alias("content"), "turn.id")
