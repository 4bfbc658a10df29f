"""Chat formatting by quotation linking.

Lines that begin with > marks are quotations of that level. Quoted passages and their lines are normalised (lower case,
single spaces, no marks at the ends) and hashed, and so are the messages' own words: the whole, each paragraph and each
line. A quotation is linked to the latest earlier message of its conversation that has its hash, else to the first
message of any other conversation that has it, if the passage has LEAST_WORDS words. A message answers the message that its first linked quotation of the
lowest level comes from, else the one before it; conversations are put in the order of answers, without quotations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fileprune.llm.common import global_rank, written

_MARKS = re.compile(r"[ \t]{0,3}>[ \t]?")
_ATTRIBUTION = re.compile(r"\s*\S.{0,200}\b(wrote|schrieb|écrit|escribió)\b.{0,20}:\s*$", re.IGNORECASE)
_ENDS = re.compile(r"^\W+|\W+$")
#: Words that a passage must have to be linked to another conversation: a short answer is nobody's quotation.
LEAST_WORDS = 3
#: Messages in a block of global numbers.
BLOCK = 1 << 17
#: Parts that the messages of a hash are dealt to.
SALTS = 16


def levels(text: str) -> list[tuple[int, str]]:
    """(level, line without its marks) of each line; level 0 is the writer's own."""
    out = []
    for line in text.splitlines():
        level, at = 0, 0
        while found := _MARKS.match(line, at):
            level, at = level + 1, found.end()
        out.append((level, line[at:] if level else line))
    return out


def passages(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The writer's own text, and the quoted passages as (level, text): runs of lines of one level. A line that only names who is quoted goes."""
    own, quoted, lines = [], [], levels(text)
    follows, after = [], 0  # the level of the next line that isn't blank, for each line
    for level, line in reversed(lines):
        follows.append(after)
        after = level if level or line.strip() else after
    follows.reverse()
    for i, (level, line) in enumerate(lines):
        if level == 0:
            if not (follows[i] and _ATTRIBUTION.match(line)):
                own.append(line)
        elif i and lines[i - 1][0] == level:
            quoted[-1][1].append(line)
        else:
            quoted.append((level, [line]))
    return "\n".join(own).strip(), [(level, "\n".join(part)) for level, part in quoted]


def normalised(text: str) -> str:
    return _ENDS.sub("", " ".join(text.lower().split()))


def digests(text: str) -> list[int]:
    """Signed hashes of the whole, of each paragraph and of each line, normalised; empty parts have none. The whole comes first.

    The lowest bit says whether the part has LEAST_WORDS words, enough to be known in another conversation.
    """
    parts = [text, *re.split(r"\n\s*\n", text), *text.splitlines()]
    found = dict.fromkeys(n for n in map(normalised, parts) if n)
    marked = (xxhash.xxh64_intdigest(n, 3) & ~1 | (n.count(" ") + 1 >= LEAST_WORDS) for n in found)
    return [h - (1 << 64) if h >> 63 else h for h in marked]


def answer_order(answers: list[int | None]) -> list[int]:
    """Message numbers in depth-first order: each message is followed by those that answer it. An answer comes after what it answers."""
    children: dict[int | None, list[int]] = {}
    for i, to in enumerate(answers):
        children.setdefault(to, []).append(i)
    out, stack = [], list(reversed(children.get(None, [])))
    while stack:
        i = stack.pop()
        out.append(i)
        stack += reversed(children.get(i, []))
    return out


def run_places(size: int, linked: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of a conversation of ``size`` messages, and their places in the order of answers.

    Message ``linked[i]`` answers the earlier message ``to[i]``; any other answers the one before it, so it follows it at once. A
    run reaches from a linked message to the next. After a run come those that answer its last message, then those that
    answer the one before, and so on.
    """
    starts = np.concatenate(([0], linked))
    lengths = np.diff(np.append(starts, size))
    parent = np.searchsorted(starts, to, side="right") - 1
    order = np.lexsort((-linked, to, parent))  # of a run the one that comes last first, as a stack takes them
    begins = np.searchsorted(parent[order], np.arange(len(starts) + 1)).tolist()
    children, places = (order + 1).tolist(), np.zeros(len(starts), np.int64)
    at, stack = 0, [0]
    while stack:
        run = stack.pop()
        places[run] = at
        at += int(lengths[run])
        stack += children[begins[run] : begins[run + 1]]
    return starts, places


_PARSED = "conv_id long, turn long, role string, own string, quotes array<struct<level:int,hashes:array<long>>>, hashes array<long>"


def parsed(conversations: DataFrame) -> DataFrame:
    """Every message with its own text, its quotations' hashes and its own words' hashes, and a row number ``id`` that stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, quotes, hashes = [], [], []
            for text in batch.column(3):
                mine, quoted = passages(text.as_py() or "")
                own.append(mine)
                quotes.append([{"level": level, "hashes": digests(part)} for level, part in quoted])
                hashes.append(digests(mine))
            quote = pa.list_(pa.struct([("level", pa.int32()), ("hashes", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.string()), pa.array(quotes, quote), pa.array(hashes, pa.list_(pa.int64()))], names=["conv_id", "turn", "role", "own", "quotes", "hashes"])

    rows = conversations.selectExpr("cast(conv_id as long) as conv_id", "cast(turn as long) as turn", "cast(role as string) as role", "text").mapInArrow(run, _PARSED)
    return written(rows.withColumn("id", F.monotonically_increasing_id()), "messages")


def quotation_links(messages: DataFrame) -> DataFrame:
    """(id, level, number, part, to_conv, to_turn, to_id): where the hashes of each message's quotations come from.

    A hash's messages are reduced to one for each conversation and turn by a running maximum, and to the
    first ones of two conversations, before they meet the quotations, so that common lines don't multiply.
    """
    own = messages.select("id", "conv_id", "turn", F.explode("hashes").alias("hash"))
    asked = (
        messages.select("id", "conv_id", "turn", F.posexplode("quotes").alias("number", "quote"))
        .select("id", "conv_id", "turn", "number", F.col("quote.level").alias("level"), F.posexplode("quote.hashes").alias("part", "hash"))
    )
    none = F.lit(None)
    both = own.join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").select("conv_id", "hash", "turn", F.lit(1).alias("asks"), F.struct("turn", "id").alias("from"), none.cast("long").alias("id"), none.cast("int").alias("number"), none.cast("int").alias("level"), none.cast("int").alias("part"))
    both = both.unionByName(asked.withColumn("asks", F.lit(0)).withColumn("from", none.cast("struct<turn:bigint,id:bigint>")))
    # of one turn, questions come before messages: a message doesn't quote itself
    earlier = F.last("from", ignorenulls=True).over(Window.partitionBy("conv_id", "hash").orderBy(F.col("turn").asc_nulls_first(), "asks", "id").rowsBetween(Window.unboundedPreceding, -1))
    within = both.withColumn("to", earlier).where("asks = 0")
    long = F.col("hash").bitwiseAND(F.lit(1)) == 1
    first = own.where(long).groupBy("hash").agg(F.min(F.struct(F.col("conv_id").isNull().alias("n"), "conv_id", "turn", "id")).alias("any"))
    # where the first conversation is the one that asks, the next; a frequent line is spread over SALTS parts
    needed = asked.select("conv_id", "hash").distinct().join(first, "hash").where(F.col("any.conv_id").eqNullSafe(F.col("conv_id")))
    needed = needed.select("hash", F.col("conv_id").alias("asks_conv"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    others = own.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(needed, ["hash", "salt"]).where(~F.col("conv_id").eqNullSafe(F.col("asks_conv")))
    second = others.groupBy("hash").agg(F.min(F.struct(F.col("conv_id").isNull().alias("n"), "conv_id", "turn", "id")).alias("next"))
    found = within.join(first, "hash", "left").join(second, "hash", "left").withColumn("other", F.when(F.col("any.conv_id").eqNullSafe(F.col("conv_id")), F.col("next")).otherwise(F.col("any")))
    return found.where("to is not null or other is not null").select(
        "id", "level", "number", "part",
        F.when(F.col("to").isNotNull(), F.col("conv_id")).otherwise(F.col("other.conv_id")).alias("to_conv"),
        F.when(F.col("to").isNotNull(), F.col("to.turn")).otherwise(F.col("other.turn")).alias("to_turn"),
        F.when(F.col("to").isNotNull(), F.col("to.id")).otherwise(F.col("other.id")).alias("to_id"),
        F.col("to").isNotNull().alias("same"),
    )


def linked_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, position, n_quotes, n_linked, quoted_conv, quoted_turn, answers_turn of every message.

    text is without quotations; position counts from 0 in the order of answers within conv_id; quoted_conv and
    quoted_turn name the message that the first linked quotation of the lowest level comes from. Null texts are empty;
    messages with a null conv_id are one conversation, null turns come first; repeated rows and equal turns are
    messages of their own, in the order of role and text. Other columns are ignored; an empty table gives no rows.
    """
    messages = parsed(conversations)
    links = quotation_links(messages)
    target = F.struct("to_conv", "to_turn", "to_id", "same")
    best = written(links.groupBy("id").agg(F.min_by(target, F.struct("level", "number", "part")).alias("to"), F.count_distinct("number").alias("n_linked")), "links")
    places = answer_places(messages, best.where("to.same").select("id", F.col("to.to_id").alias("answers")))
    return messages.join(places, "id").join(best, "id", "left").select(
        "conv_id", "turn", "role", F.col("own").alias("text"), "position", F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("int").alias("n_linked"),
        F.col("to.to_conv").alias("quoted_conv"), F.col("to.to_turn").alias("quoted_turn"), "answers_turn",
    )


def answer_places(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, position, answers_turn) of all ``messages`` (id, conv_id, turn, role, own), of which ``answers`` (id, answers) says what some answer.

    Messages get global numbers by conversation and turn; those of one conversation needn't meet in a task. Only its linked
    messages do, as three numbers each. The run that a message belongs to is the last one that starts before it, found in
    blocks of BLOCK messages.
    """
    narrow = messages.select("id", "conv_id", "turn", "role", F.md5("own").alias("_own"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("_own").asc(), F.col("id").asc()]
    ranked = written(global_rank(narrow, order, "messages-by-turn", "rank").select("id", "conv_id", "turn", "rank"), "message-ranks")
    sizes = written(ranked.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("size")), "conversations")
    linked = answers.join(ranked, "id").join(ranked.select(F.col("id").alias("answers"), F.col("rank").alias("to"), F.col("turn").alias("to_turn")), "answers").where("to < rank")
    linked = written(linked.alias("l").join(sizes.alias("s"), F.col("l.conv_id").eqNullSafe(F.col("s.conv_id"))).select("id", "rank", "to", "to_turn", "first", "size"), "linked-messages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def closed() -> pa.RecordBatch:
            first, size = now
            ranks, to = (np.concatenate(x) - first for x in zip(*held))
            starts, places = run_places(size, ranks, to)
            return pa.RecordBatch.from_pydict({"start": pa.array(starts + first, pa.int64()), "place": pa.array(places, pa.int64())})

        for batch in batches:
            first, size, rank, to = (batch.column(i).to_numpy() for i in range(4))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(first)) + 1, [len(first)])).tolist() if len(first) else []
            for a, b in zip(cuts, cuts[1:]):
                if held and int(first[a]) != now[0]:
                    yield closed()
                    held = []
                now = (int(first[a]), int(size[a]))
                held.append((rank[a:b], to[a:b]))
        if held:
            yield closed()

    places = linked.select("first", "size", "rank", "to").repartition("first").sortWithinPartitions("first", "rank").mapInArrow(run, "start long, place long")
    starts = linked.select("rank").union(sizes.select("first"))
    block = F.floor(F.col("rank") / F.lit(BLOCK)).cast("long").alias("block")
    marked = ranked.select("id", "turn", "rank", block).join(starts.select("rank", F.col("rank").alias("start")), "rank", "left")
    before = marked.groupBy("block").agg(F.max("start").alias("last"))
    carried = before.select("block", F.max("last").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))  # a row for each BLOCK messages
    within = F.max("start").over(Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("within", within).join(carried, "block").select("id", "turn", "rank", F.coalesce("within", "carried").alias("start"))
    told = linked.select(F.col("id").alias("_id"), "to_turn")
    previous = ranked.select((F.col("rank") + 1).alias("rank"), F.col("turn").alias("before"))
    first = sizes.select(F.col("first").alias("rank"), F.lit(True).alias("opens"))
    out = runs.join(places, "start", "left").join(previous, "rank", "left").join(first, "rank", "left").join(told, F.col("id") == F.col("_id"), "left")
    turn = F.when(F.col("_id").isNotNull(), F.col("to_turn")).when(F.col("opens").isNull(), F.col("before"))
    return out.select("id", (F.coalesce("place", F.lit(0)) + F.col("rank") - F.col("start")).cast("long").alias("position"), turn.alias("answers_turn"))


def transcripts(linked: DataFrame, template: str = "<|%s|>\n%s\n") -> DataFrame:
    """conv_id, text: each conversation in the order of answers, as one string. For conversations that fit in a row."""
    turn = F.format_string(template, F.coalesce("role", F.lit("")), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("position", turn.alias("turn"))))
    return linked.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["turn"]), "").alias("text"))
