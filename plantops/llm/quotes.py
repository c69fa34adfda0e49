"""Quotation linking: messages that quote others become reply-ordered
conversations without quotes.

1. Each message is parsed into nested quote levels: a line's level is the
   number of ``>`` marks before it.  Lines of one level that follow each other
   are a passage; level 0 is the message's own text.  The lines that announce a
   quote ("On Mon, Ann / wrote:") go with the quote.
2. A message's own text and the passages it quotes are split alike: as a whole,
   by blank-line blocks, by lines and by sentences, which need not end with a
   line.  Each part is normalised (white space, letter case) and hashed.
   Own parts travel only if a bit map of quoted hashes (``FILTER_BITS``, the same
   size for any input) may hold them; a semi join then decides.
3. For each hash the first message that says it, in each conversation and in
   the first two conversations, is found by an aggregation; quoted parts join these by equality.
   The keys are unique on that side, so a passage that very many messages share
   cannot multiply rows.  Of one way of splitting, the parts that join must
   make up half of the passage's words or more; the way with most words counts,
   the own conversation before others.  A message that says all parts comes no
   earlier than the first sayer of any, so the passage's original is the latest
   of its parts' first sayers.
4. A message replies to the latest of the originals of its level-1 quotes that
   lie before it in its conversation.  Pointer jumping gives each message the
   root of its thread; a conversation lists its threads by their first turn.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantops.llm.common import materialise, whole_text
from plantops.operators.ordinal import ordinal

_MARKS = re.compile(r"(?:[ \t]{0,3}>)+[ \t]?")
_ANNOUNCE = re.compile(r"(?i)\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$")
_OPENS = re.compile(r"(?i)\s*(?:on|am|le|el)\b.*(?:\d|\b(?:mon|tue|wed|thu|fri|sat|sun|mo|di|mi|do|fr|sa|so|lun|mar|mer|jeu|ven|sam|dim|mié|jue|vie|sáb|dom)[a-zäéí]*\b)")

#: Lines that an announcement may be wrapped to.
_WRAPPED = 3

_BLANK = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")

#: Bits of the map of quoted hashes that every task gets (16 MB): one for each
#: value of a hash's first 27 bits.
FILTER_BITS = 1 << 27

_PART = pa.struct([("way", pa.int32()), ("h", pa.binary()), ("words", pa.int64()), ("of", pa.int32())])


def announced(lines: list[str]) -> int:
    """How many of the lines are left without the announcement of a quote that
    ends them.  It ends in "wrote:" or the like, blank lines may follow; a
    wrapped one starts up to two lines earlier, at a line that opens with a
    date ("On Mon, ...")."""
    end = len(lines)
    while end and not lines[end - 1].strip():
        end -= 1
    if not end or not _ANNOUNCE.search(lines[end - 1]):
        return len(lines)
    for i in range(end - 1, max(end - 1 - _WRAPPED, -1), -1):
        if not lines[i].strip():
            break
        if _OPENS.match(lines[i]):
            return i
    return end - 1


def parse(text: str) -> list[tuple[int, str]]:
    """(level, passage) in the order of the text; level 0 is own text."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        level, rest = (m.group().count(">"), line[m.end():]) if m else (0, line)
        if out and out[-1][0] == level:
            out[-1][1].append(rest)
        else:
            if out and level > out[-1][0]:
                del out[-1][1][announced(out[-1][1]):]
                if not out[-1][1]:
                    out.pop()
            out.append((level, [rest]))
    return [(level, "\n".join(lines)) for level, lines in out]


def normal_hash(passage: str) -> bytes | None:
    """Hash of the passage without marks of layout; None if nothing is left."""
    words = passage.casefold().split()
    return hashlib.sha256(" ".join(words).encode()).digest()[:16] if words else None


def ways(text: str) -> list[list[str]]:
    """The text as a whole, its blank-line blocks, its lines, its sentences."""
    blocks = _BLANK.split(text)
    return [[text], blocks, text.split("\n"), [s for b in blocks for s in _SENTENCE.split(b)]]


def own_passages(body: str) -> set[bytes]:
    return {h for way in ways(body) for h in map(normal_hash, way) if h}


def quoted_parts(passage: str) -> list[tuple[int, bytes, int]]:
    """(way, hash, words) of each part; a way that splits like an earlier one is left out."""
    out: list[dict[bytes, int]] = []
    for way in ways(passage):
        words: dict[bytes, int] = {}
        for part in way:
            if h := normal_hash(part):
                words[h] = words.get(h, 0) + len(part.split())
        out.append({} if words in out else words)
    return [(i, h, n) for i, words in enumerate(out) for h, n in words.items()]


def _bit_map(quotes: DataFrame) -> bytes:
    """A bit for the first 27 bits of each hash ``h``, as bytes; its size does
    not depend on the rows, which are brought together on Spark's side."""
    place = F.shiftright(F.conv(F.hex(F.substring("h", 1, 4)), 16, 10).cast("long"), 5)
    words = (quotes.select(place.alias("place")).selectExpr("cast(shiftright(place, 6) as int) at", "shiftleft(1L, cast(place & 63 as int)) bit")
             .groupBy("at").agg(F.bit_or("bit").alias("bits"))).toArrow()
    out = np.zeros(FILTER_BITS // 64, "<i8")
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.tobytes()


def link_quotes(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, body (own text), n_quotes (quoted
    passages), n_linked (those with an original, see step 3), max_level, reply_to_conv and
    reply_to_turn (null: no original), thread (turn of the thread's root) and
    position (gapless from 0 in the conversation, threads by first turn).

    Null text counts as empty.  A row without conv_id or turn links to nothing
    and is its own thread; rows that repeat (conv_id, turn) are each listed,
    beside each other, and count as one message for others; a quote of a later
    or the same turn is not linked; an empty table gives no row."""
    src = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), whole_text().alias("text"))

    def run(batches):
        for rb in batches:
            body, level, digest, parts = [], [], [], []
            for t in rb.column(3):
                passages = parse(t.as_py())
                body.append("\n".join(p for n, p in passages if not n).strip("\n"))
                quoted = [(n, h, p) for n, p in passages if n and (h := normal_hash(p))]
                level.append([n for n, _, _ in quoted])
                digest.append([h for _, h, _ in quoted])
                parts.append([{"way": i, "h": h, "words": w, "of": k} for k, (_, _, p) in enumerate(quoted) for i, h, w in quoted_parts(p)])
            yield pa.RecordBatch.from_arrays([*rb.columns[:3], pa.array(body, pa.string()), pa.array(level, pa.list_(pa.int32())), pa.array(digest, pa.list_(pa.binary())), pa.array(parts, pa.list_(_PART))],
                                             names=["conv_id", "turn", "role", "body", "level", "digest", "parts"])

    parsed = materialise(src.mapInArrow(run, "conv_id bigint, turn bigint, role string, body string, level array<int>, digest array<binary>, parts array<struct<way: int, h: binary, words: bigint, of: int>>"), "messages")
    placed = parsed.where("conv_id is not null and turn is not null")
    # a passage is known by its level and its whole hash: one that a message repeats counts once
    quotes = (placed.select("conv_id", "turn", "level", "digest", F.explode("parts").alias("p"))
              .select("conv_id", "turn", F.col("level")[F.col("p.of")].alias("level"), F.col("digest")[F.col("p.of")].alias("passage"), "p.way", "p.h", "p.words").distinct())
    quoted_bits = messages.sparkSession.sparkContext.broadcast(_bit_map(quotes))

    def index(batches):
        bits = quoted_bits.value
        for rb in batches:
            row, h = [], []
            for i, t in enumerate(rb.column(2)):
                own = sorted(h for h in own_passages(t.as_py()) if bits[h[0] << 16 | h[1] << 8 | h[2]] >> (h[3] >> 5) & 1)
                row += [i] * len(own)
                h += own
            yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(row, pa.int64())), rb.column(1).take(pa.array(row, pa.int64())), pa.array(h, pa.binary())], names=["conv_id", "turn", "h"])

    # only what somebody quotes needs an index; the bit map keeps most of the rest at home, a semi join all of it
    said = placed.select("conv_id", "turn", "body").mapInArrow(index, "conv_id bigint, turn bigint, h binary").join(quotes.select("h").distinct(), "h", "left_semi")
    # written, so that the joins with them are of two plain shuffles, which AQE splits at a hot passage
    here = materialise(said.groupBy("h", "conv_id").agg(F.min("turn").alias("turn_here")), "said-here")
    # of the two first conversations, so that one outside the quoting conversation is at hand
    least = F.min(F.struct(F.col("conv_id").alias("c"), F.col("turn_here").alias("t")))
    first = materialise(here.groupBy("h").agg(least.alias("first")), "said-first")
    second = here.join(first, "h").where(F.col("conv_id") != F.col("first.c")).groupBy("h").agg(least.alias("second"))
    first = materialise(first.join(second, "h", "left"), "said-first")
    part = (quotes.join(here, ["h", "conv_id"], "left").join(first, "h", "left")
            .withColumn("near", F.when(F.col("turn_here") < F.col("turn"), F.struct(F.col("conv_id").alias("c"), F.col("turn_here").alias("t"))))
            .withColumn("far", F.when(F.col("first.c") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))))
    found = part.groupBy("conv_id", "turn", "level", "passage", "way").agg(F.sum("words").alias("all"), *[x for side in ("near", "far") for x in (
        F.max(side).alias(side), F.coalesce(F.sum(F.when(F.col(side).isNotNull(), F.col("words"))), F.lit(0)).alias(f"{side}_words"))])
    enough = [F.when(2 * F.col(f"{side}_words") >= F.col("all"), F.struct(F.col(f"{side}_words").alias("words"), F.lit(side == "near").alias("near"), (-F.col("way")).alias("way"), F.col(side).alias("to"))) for side in ("near", "far")]
    found = (found.groupBy("conv_id", "turn", "level", "passage").agg(F.max(F.greatest(*enough)).alias("best"))
             .withColumn("original", F.col("best.to")).withColumn("near", F.when(F.col("best.near"), F.col("best.to"))))
    direct = F.when(F.col("level") == 1, F.col("near"))
    replies = materialise(found.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("original").isNotNull(), 1).otherwise(0)).alias("n_linked"), F.max("level").alias("max_level"),
        F.coalesce(F.max(direct), F.max(F.when(F.col("level") == 1, F.col("original"))), F.max("near"), F.max("original")).alias("to")), "replies")

    up = materialise(replies.where("to.c = conv_id").select("conv_id", "turn", F.col("to.t").alias("root")), "threads")
    while True:  # each round doubles the length of what a pointer spans
        over = up.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root").alias("next"))
        new = up.join(over, (F.col("conv_id") == F.col("c")) & (F.col("root") == F.col("t")), "left")
        new = materialise(new.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "threads")
        up = new.drop("moved")
        if not new.where("moved").take(1):
            break

    on = [F.col("conv_id") == F.col("__c"), F.col("turn") == F.col("__t")]
    known = (replies.join(up, ["conv_id", "turn"], "left")
             .select(F.col("conv_id").alias("__c"), F.col("turn").alias("__t"), "n_linked", "max_level", F.col("to.c").alias("reply_to_conv"), F.col("to.t").alias("reply_to_turn"), "root"))
    out = parsed.withColumn("n_quotes", F.size("digest").cast("long")).drop("level", "digest", "parts").join(known, on, "left").withColumn("thread", F.coalesce("root", "turn"))
    # numbered over ranges of (conversation, thread, turn), so neither a long conversation nor a long thread is one task's;
    # repeats of a turn are ordered by a hash, as range bounds must not carry whole texts to the driver
    out = out.withColumn("__same", F.xxhash64("role", "body"))
    numbered = ordinal(out, ["conv_id"], ["thread", "turn", "__same"], "position").withColumn("position", F.col("position") - 1)
    return numbered.select("conv_id", "turn", "role", "body", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
                           F.coalesce("max_level", F.lit(0)).cast("int").alias("max_level"), "reply_to_conv", "reply_to_turn", "thread", "position")
