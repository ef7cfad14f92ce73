"""Quotation linking for conversations, in DataFrame operations only.

Messages may quote earlier ones, line by line, with markers such as "> " or "> > "; the number of markers
is the quote level. Every quoted line is a passage: its markers are taken off, what is left is normalised
(letters and digits in lower case, single spaces) and hashed. Passages are joined, within their
conversation, to the first message that holds the same line unquoted. A message's parent is the earlier
message to which most of its passages of the lowest linked level lead (the later message on a tie). Messages
that hang together by parents form a thread; a conversation is its threads in order of their first turn, and
in a thread a parent always precedes its replies. The text that is returned has no quoted lines and no
attribution line ("On ... wrote:") before them.

The link table has one row for each (conversation, passage) that is both quoted and original: originals are
reduced to their first turn by partial aggregation before the shuffle. Quoted passages join it with a salt,
over which the link rows are repeated, so a passage that is quoted a great many times in one conversation is
spread over SALTS tasks. Positions come from a range sort, so a conversation of any size may cover several
tasks. Threads are found by pointer jumping over quoted links alone.

Results for odd input: a null or empty text is a message without lines and with empty text; rows with null
conv_id or turn stay, unlinked; repeated rows are each returned, at positions next to each other; an empty
table stays empty; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored, with_position

MARKERS = r"^(?:[ \t]*>)+"
ATTRIBUTION = r"^[ \t]*(?:On|Am|Le|El)\b.*(?:wrote|schrieb|écrit|escribió)[^:]*:[ \t]*$"
SALTS = 16


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKERS, 0), "[^>]", ""))


def _normal(line: Column) -> Column:
    bare = F.regexp_replace(line, MARKERS, "")
    return F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "))


def _marked(text: Column) -> Column:
    """The lines of a text, each with whether it is an attribution: it says who wrote what, and a quote follows."""
    lines = _lines(text)
    follows = lambda i: F.coalesce(F.get(lines, i + 1).rlike(MARKERS), F.lit(False))
    return F.transform(lines, lambda x, i: F.struct(x.alias("line"), (x.rlike(ATTRIBUTION) & follows(i)).alias("attribution")))


def own_text(text: Column) -> Column:
    """The text without quoted and attribution lines, and without blank lines at either end."""
    kept = F.filter(_marked(text), lambda x: ~(x["line"].rlike(MARKERS) | x["attribution"]))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), r"^\n+|\n+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage: a row for each line that is not blank; level 0 is a message's own."""
    line = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", F.explode(_marked(F.col("text"))).alias("l"))
    split = line.where(~F.col("l.attribution")).select("conv_id", "turn", _level(F.col("l.line")).alias("level"), _normal(F.col("l.line")).alias("words"))
    return split.where(F.col("words") != "").select("conv_id", "turn", "level", F.md5("words").alias("passage"))


def quote_links(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(quoted, links): a row for each quoted line, with `salt`; (conv_id, turn, parent) of linked messages,
    with n_linked."""
    quoting = messages.where(F.coalesce(F.col("text"), F.lit("")).rlike("(?m)" + MARKERS))
    quoted = passages(quoting).where(F.col("level") > 0).withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)))
    originals = passages(messages).where(F.col("level") == 0)
    both = originals.select("conv_id", "passage", F.col("turn").alias("first"), F.lit(0).alias("q")).unionByName(
        quoted.select("conv_id", "passage", F.lit(None).cast("long").alias("first"), F.lit(1).alias("q"))
    )
    table = (
        both.groupBy("conv_id", "passage")
        .agg(F.min("first").alias("first"), F.max("q").alias("q"))
        .where((F.col("q") == 1) & F.col("first").isNotNull())
        .select("conv_id", "passage", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    )
    found = quoted.join(table, ["conv_id", "passage", "salt"]).where(F.col("first") < F.col("turn"))
    votes = found.groupBy("conv_id", "turn", "level", "first").agg(F.count(F.lit(1)).alias("n"))
    parents = votes.groupBy("conv_id", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("level"), "n", "first")).getField("first").alias("parent"), F.sum("n").alias("n_linked")
    )
    return quoted, parents


def threads(parents: DataFrame) -> DataFrame:
    """conv_id, turn, parent, n_linked, thread (the first turn above it), by pointer jumping."""
    at = stored(parents.withColumn("thread", F.col("parent")), "quote-threads")
    while True:
        above = at.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("higher"))
        step = stored(at.join(above, ["conv_id", "thread"], "left"), "quote-threads")
        at = step.select("conv_id", "turn", "parent", "n_linked", F.coalesce("higher", "thread").alias("thread"))
        if step.where(F.col("higher").isNotNull()).isEmpty():
            return at


def link_quotes(messages: DataFrame) -> DataFrame:
    """Every message: conv_id, turn, role, text (its own), parent_turn, thread_turn, position in its
    conversation from 0, n_quoted and n_linked lines."""
    messages = messages.select("conv_id", "turn", "role", "text")
    quoted, parents = quote_links(messages)
    linked = threads(parents)
    counts = quoted.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_quoted"))
    facts = stored(counts.join(linked, ["conv_id", "turn"], "left"), "quote-facts")
    joined = messages.join(facts, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        own_text(F.col("text")).alias("text"),
        F.col("parent").alias("parent_turn"),
        F.coalesce("thread", "turn").alias("thread_turn"),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
    placed = with_position(joined, ["conv_id", "thread_turn", "turn", "role", "text"], "quote-order")
    starts = placed.groupBy("conv_id").agg(F.min("pos").alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("s_conv"))
    return (
        placed.join(starts.withColumnRenamed("conv_id", "s_conv"), same)
        .withColumn("position", F.col("pos") - F.col("first"))
        .drop("pos", "first", "s_conv")
    )


ORACLE = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l0 AS (SELECT id, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m),
l AS (SELECT *, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS lev,
  regexp_matches(line, '^[ \t]*(?:On|Am|Le|El)\b.*(?:wrote|schrieb|écrit|escribió)[^:]*:[ \t]*$') AND coalesce(regexp_matches(lead(line) OVER (PARTITION BY id ORDER BY i), '^(?:[ \t]*>)+'), false) AS attr,
  trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+', '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS words FROM l0),
p AS (SELECT conv_id, turn, lev, words FROM l WHERE NOT attr AND words <> ''),
o AS (SELECT conv_id, words, min(turn) AS first FROM p WHERE lev = 0 GROUP BY ALL),
v AS (SELECT p.conv_id, p.turn, p.lev, o.first, count(*) AS n FROM p JOIN o USING (conv_id, words) WHERE lev > 0 AND first < turn GROUP BY ALL),
k AS (SELECT conv_id, turn, first AS parent, row_number() OVER (PARTITION BY conv_id, turn ORDER BY lev, n DESC, first DESC) AS r FROM v),
par AS (SELECT conv_id, turn, parent FROM k WHERE r = 1),
n AS (SELECT conv_id, turn, sum(n) AS n_linked FROM v GROUP BY ALL),
up AS (SELECT conv_id, turn, parent AS thread FROM par UNION SELECT up.conv_id, up.turn, par.parent FROM up JOIN par ON up.conv_id = par.conv_id AND up.thread = par.turn),
th AS (SELECT conv_id, turn, min(thread) AS thread FROM up GROUP BY ALL),
own AS (SELECT id, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\n+|\n+$', '', 'g') AS text FROM l WHERE lev = 0 AND NOT attr GROUP BY id),
q AS (SELECT conv_id, turn, count(*) AS n_quoted FROM p WHERE lev > 0 GROUP BY ALL),
r AS (SELECT m.conv_id, m.turn, m.role, coalesce(own.text, '') AS text, par.parent AS parent_turn, coalesce(th.thread, m.turn) AS thread_turn,
  CAST(coalesce(q.n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(n.n_linked, 0) AS BIGINT) AS n_linked
  FROM m LEFT JOIN own USING (id) LEFT JOIN par ON par.conv_id = m.conv_id AND par.turn = m.turn
  LEFT JOIN th ON th.conv_id = m.conv_id AND th.turn = m.turn LEFT JOIN q ON q.conv_id = m.conv_id AND q.turn = m.turn
  LEFT JOIN n ON n.conv_id = m.conv_id AND n.turn = m.turn)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY thread_turn, turn, role, text) - 1 AS position FROM r
"""
