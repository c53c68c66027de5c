"""Chat formatting: collapse of cumulative snapshots, then rendering.

A log often holds a conversation again and again, one turn longer each time. Rolling hashes of all turn prefixes
identify a conversation that is a prefix of a longer one; anti-joins keep maximal conversations, of equal ones
the smallest id.

No step needs a conversation in one task. Turns are numbered by a range exchange (``trie.numbered``). The hash of a prefix is
the exclusive or of 120 hashed bits per (position, turn), so it rolls over blocks of BLOCK turns apart and is put together from
the blocks' totals. Prefixes meet as (length, hash) rows. Conversations are rendered in parts of PART turns at most
(``collapse_and_render``), or whole, with the SHA-256 chain of their turns (``collapse_whole``): then the text of a conversation is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .trie import numbered

BLOCK = 256
#: Turns that are rendered as one text. A conversation of up to so many turns is one row.
PART = 256
HASH = ["ha", "hb"]


def _bits(text: Column, at: int) -> Column:
    """60 bits of a SHA-256."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), at, 15), 16, 10).cast("long")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, n_turns, ha, hb): the hash of the first ``pos`` turns of each conversation, for all its prefixes.

    ``turns`` has conv_id, pos (from 1) and da, db, which name a turn's role and text."""
    named = F.concat_ws(":", "pos", "da", "db")
    rows = turns.select("conv_id", "pos", _bits(named, 1).alias("a"), _bits(named, 16).alias("b"), F.floor((F.col("pos") - 1) / BLOCK).alias("block"))
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = rows.select("conv_id", "pos", "block", *[F.bit_xor(c).over(inside).alias(h) for c, h in zip("ab", HASH)])
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count("*").alias("n"))
    # one row per BLOCK turns
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"_{c}") for c in "ab"],
                           F.sum("n").over(Window.partitionBy("conv_id")).alias("n_turns"))
    return rolled.join(blocks, ["conv_id", "block"]).select(
        "conv_id", "pos", "n_turns", F.col("ha").bitwiseXOR(F.col("_a")).alias("ha"), F.col("hb").bitwiseXOR(F.col("_b")).alias("hb"))


def maximal(prefixes: DataFrame, least: Column) -> DataFrame:
    """(keep_id, n_turns, ha, hb): conversations that are no proper prefix of another, one of each group of equal ones."""
    full = prefixes.where("pos = n_turns").groupBy("n_turns", *HASH).agg(least.alias("keep_id"))
    shorter = prefixes.where("pos < n_turns").select(F.col("pos").alias("n_turns"), *HASH).distinct()
    return full.join(shorter, ["n_turns", *HASH], "left_anti")


def _kept_turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(conv_id, pos, shown, own) of the conversations that stay, (keep_id, n_turns, ha, hb), and the number that stands for no id.

    ``own`` is the SHA-256 of a turn's role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    ends = rows.agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi")).first()
    nobody = 0 if ends["lo"] is None else ends["lo"] - 1 if ends["lo"] > -(1 << 63) else ends["hi"] + 1  # an id that no row has
    rows = rows.withColumn("conv_id", F.coalesce("conv_id", F.lit(nobody).cast("long")))
    placed = materialize(numbered(rows, "conv_id", "turn", "role", "text").drop("chars"))
    prefixes = prefix_hashes(placed)
    # among equal conversations one with an id stays
    least = F.coalesce(F.min(F.when(F.col("conv_id") != nobody, F.col("conv_id"))), F.lit(nobody).cast("long"))
    kept = materialize(maximal(prefixes, least))
    # each distinct turn of a kept conversation once, then a row for each place it stands at
    named = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    part = lambda at: F.conv(F.substring("own", at, 15), 16, 10).cast("long")
    spoken = rows.join(kept.select(F.col("keep_id").alias("conv_id")), "conv_id", "left_semi").withColumn("own", named)
    shown = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>")).alias("shown")
    texts = spoken.select("conv_id", part(1).alias("da"), part(16).alias("db"), shown, "own").dropDuplicates(["conv_id", "da", "db"])
    return placed.join(texts, ["conv_id", "da", "db"]).select("conv_id", "pos", "shown", "own"), kept, nobody


def _joined(of: str) -> Column:
    """The group's turns in their order, as one text."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", of))), lambda x: x[of]), "\n")


def collapse_and_render(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Maximal conversations, rendered: conv_id, part, n_turns (of the whole conversation), rendered, chain_hash (of all turns).

    A conversation of up to PART turns is one row, part 0; a longer one has a row for each PART turns, to be joined by line feeds.

    Turns are ordered by (turn, role, text), null turn first (role and text by their first 32 characters, then by digest); null role or
    text counts as empty. Repeated turn rows stay turns. Rows without conversation id form one conversation of null id, dealt
    out like any other. Equal conversations: the smallest non-null id stays. Empty table: no rows. Other columns are ignored.
    """
    lines, kept, nobody = _kept_turns(turns, id_col, turn_col, role_col, text_col)
    lines = lines.withColumn("part", F.floor((F.col("pos") - 1) / PART))
    # at most PART turns each
    parts = lines.groupBy("conv_id", "part").agg(_joined("shown").alias("rendered"))
    chain = F.lower(F.concat(*[F.lpad(F.hex(h), 15, "0") for h in HASH])).alias("chain_hash")
    return parts.join(kept, parts["conv_id"] == kept["keep_id"]).select(
        F.when(F.col("conv_id") != nobody, F.col("conv_id")).alias("conv_id"), "part", F.col("n_turns").cast("int").alias("n_turns"), "rendered", chain)


def collapse_whole(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Maximal conversations as in ``collapse_and_render``, a row each: conv_id, n_turns, rendered (the whole text), chain_sha256.

    The chain of no turn is the empty text; that of a turn is the SHA-256 of the chain before it and the turn's own SHA-256, in hex.
    What a row holds is what it says: the conversation's text, and 64 characters a turn while the chain is computed."""
    lines, _, nobody = _kept_turns(turns, id_col, turn_col, role_col, text_col)
    rows = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "shown", "own"))).alias("l"))
    chain = F.aggregate("l", F.lit(""), lambda a, x: F.sha2(F.concat(a, x["own"]).cast("binary"), 256))
    return rows.select(F.when(F.col("conv_id") != nobody, F.col("conv_id")).alias("conv_id"), F.size("l").alias("n_turns"),
                       F.array_join(F.transform("l", lambda x: x["shown"]), "\n").alias("rendered"), chain.alias("chain_sha256"))
