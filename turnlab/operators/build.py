"""Building turns and conversations out of utterances."""

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlab.functions.clean import round_exact
from turnlab.functions.counts import rows_n
from turnlab.functions.labels import parse_list
from turnlab.operators.blocks import BLOCK, CUT, ROWS_PER_BLOCK, with_block
from turnlab.operators.ordering import least_rows, row_index


def _in_order(order, *cols):
    """The rows of a group as an array of structs in file order; groups here are single turns."""
    return F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), *cols)))


def merge_turns(u, text="sentence", label_lists=(), numbers=(), order="idx"):
    """One row per (dialogue, role, turn): texts joined in file order, label lists concatenated.

    Label lists are list text and keep repeats; numbers are collected with NULL as 0, to 3 decimals.
    """
    fields = [F.coalesce(F.col(text), F.lit("")).alias("_t")]
    fields += [parse_list(c).alias(c) for c in label_lists]
    fields += [round_exact(F.coalesce(F.col(c), F.lit(0.0)), 3).alias(c) for c in numbers]
    rows = u.groupBy("dialogue_id", "role", "turn").agg(
        _in_order(order, *fields).alias("_rows"), F.min(order).alias(order))
    pick = lambda c: F.transform("_rows", lambda r: r[c])
    return rows.select(
        order, "dialogue_id", "role", "turn", F.array_join(pick("_t"), " ").alias(text),
        *[F.flatten(pick(c)).alias(c) for c in label_lists],
        *[pick(c).alias(c) for c in numbers])


def with_row_index(t, order="idx"):
    """File order as a dense number 0..n-1."""
    return row_index(t, order)


def _texts(order, text):
    """Texts of a group joined by a blank, in the order of a column."""
    rows = _in_order(order, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return F.array_join(F.transform(rows, lambda r: r["_t"]), " ")


def merge_runs(u, conversation, speaker, order, text, flag=None, label=None,
               block=ROWS_PER_BLOCK):
    """Join consecutive utterances of one speaker in a conversation.

    ``flag`` takes the run's largest value, ``label`` the run's sorted distinct labels. A run is
    named by the file position of its first utterance.

    Runs are built inside blocks first. Where a conversation is cut, a block's first run is then put together with the
    run it continues, which is found in a table of one row per block.
    """
    inside = W.partitionBy(conversation, BLOCK).orderBy(order)
    before = F.lag(F.struct(speaker)).over(inside)
    change = before.isNull() | ~before[speaker].eqNullSafe(F.col(speaker))
    started = with_block(u, conversation, order, block).withColumn("_start", F.when(change, F.col(order)))
    named = started.withColumn("_run", F.max("_start").over(
        inside.rowsBetween(W.unboundedPreceding, 0)))
    parts = named.groupBy(conversation, BLOCK, CUT, "_run").agg(
        F.min(speaker).alias(speaker), _texts(order, text).alias(text), rows_n().alias("utterances"),
        *([F.max(flag).alias(flag)] if flag else []),
        *([F.collect_set(label).alias(label)] if label else []))

    along = W.partitionBy(conversation).orderBy(BLOCK)
    ends = parts.where(CUT).groupBy(conversation, BLOCK).agg(
        F.min("_run").alias("_first"), F.max("_run").alias("_last"),
        F.min_by(speaker, "_run").alias("_opens"), F.max_by(speaker, "_run").alias("_closes"))
    continues = (F.lag(BLOCK).over(along).isNotNull()
                 & F.lag("_closes").over(along).eqNullSafe(F.col("_opens")))
    linked = ends.withColumn("_continues", continues)
    begun = F.when(~F.col("_continues") | (F.col("_first") < F.col("_last")), F.col("_last"))
    heads = (linked.withColumn("_begun", begun)
             .withColumn("_head", F.last("_begun", ignorenulls=True).over(
                 along.rowsBetween(W.unboundedPreceding, -1)))
             .where("_continues").select(conversation, BLOCK, "_first", "_head"))

    head = F.when(F.col("_run") == F.col("_first"), F.col("_head"))
    whole = parts.join(heads, [conversation, BLOCK], "left").withColumn(
        "_name", F.coalesce(head, F.col("_run")))
    merged = whole.groupBy(conversation, "_name").agg(
        F.min(speaker).alias(speaker), _texts("_run", text).alias(text),
        F.sum("utterances").alias("utterances"),
        *([F.max(flag).alias(flag)] if flag else []),
        *([F.array_sort(F.array_distinct(F.flatten(F.collect_list(label)))).alias(label)]
          if label else []))
    return merged.withColumnRenamed("_name", order)


def number_turns(runs, conversation, speaker, order, block=ROWS_PER_BLOCK):
    """Turn number of a run: the largest number of runs any speaker has had so far, minus one.

    Counted inside blocks. A block of a conversation that is cut begins with a few rows that stand for what lies
    before it: the earlier runs of each of its speakers, and the peak so far.
    """
    who = F.coalesce(F.col(speaker).cast("string"), F.lit("")).alias("_who")
    rows = with_block(runs, conversation, order, block).select("*", who, F.lit(1).cast("long").alias("_n"))
    counts = rows.where(CUT).groupBy(conversation, BLOCK, "_who").agg(rows_n().alias("_n"))
    earlier = W.partitionBy(conversation, "_who").orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    offset = counts.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    so_far = W.partitionBy(conversation).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    peaks = (offset.groupBy(conversation, BLOCK).agg(F.max(F.col("_off") + F.col("_n")).alias("_peak"))
             .withColumn("_n", F.max("_peak").over(so_far)).where("_n IS NOT NULL"))
    handed = offset.where("_off > 0").select(conversation, BLOCK, "_who", F.col("_off").alias("_n")).union(
        peaks.select(conversation, BLOCK, F.lit(None).cast("string").alias("_who"), "_n"))

    # one exchange by (conversation, block) serves both windows
    placed = (rows.select("*", F.lit(True).alias("_own")).unionByName(handed, allowMissingColumns=True)
              .repartition(conversation, BLOCK))
    first = F.col(order).asc_nulls_first()
    own = W.partitionBy(conversation, BLOCK, "_who").orderBy(first).rowsBetween(W.unboundedPreceding, 0)
    inside = W.partitionBy(conversation, BLOCK).orderBy(first).rowsBetween(W.unboundedPreceding, 0)
    return (placed.withColumn("_nth", F.sum("_n").over(own)).withColumn("turn", F.max("_nth").over(inside) - 1)
            .where("_own").select(*runs.columns, "turn"))


def _listed(t, value, dialogue, order, block):
    """(dialogue, _list): a value of all rows of a dialogue in order; pieces are sorted block by block, then joined."""
    rows = with_block(t.select(dialogue, order, value.alias("_v")), dialogue, order, block)
    pieces = rows.groupBy(dialogue, BLOCK).agg(F.transform(_in_order(order, "_v"), lambda r: r["_v"]).alias("_p"))
    whole = F.flatten(F.transform(_in_order(BLOCK, "_p"), lambda r: r["_p"]))
    return pieces.groupBy(dialogue).agg(whole.alias("_list"))


def long_form(t, value, dialogue="dialogue_id", order="idx", size=None, block=ROWS_PER_BLOCK):
    """(dialogue, order, position, value): values of a dialogue numbered from 0 in order, a row each.

    The form of ``da_sequence`` and ``dialogue_context`` for dialogues of any length. With ``size``, a function of the value
    and its position, also ``before``: the sum of the sizes of the earlier values. Both are counted inside blocks; a
    dialogue that is cut takes its offsets from a table of one row per block.
    """
    inside = W.partitionBy(dialogue, BLOCK).orderBy(order)
    rows = with_block(t.select(dialogue, order, value.alias("value")), dialogue, order, block)
    numbered = rows.withColumn("_nth", F.row_number().over(inside).cast("long") - 1)
    so_far = W.partitionBy(dialogue).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)

    def shifted(numbered, total, name, within):
        blocks = numbered.where(CUT).groupBy(dialogue, BLOCK).agg(total.alias("_total"))
        offsets = blocks.select(dialogue, BLOCK, F.sum("_total").over(so_far).alias("_off"))
        at = F.col(within) + F.coalesce(F.col("_off"), F.lit(0).cast("long"))
        return numbered.join(offsets, [dialogue, BLOCK], "left").withColumn(name, at).drop("_off", within)

    placed = shifted(numbered, rows_n(), "position", "_nth")
    if size is None:
        return placed.select(dialogue, order, "position", "value")
    sized = placed.withColumn("_size", size(F.col("value"), F.col("position")).cast("long"))
    within = F.coalesce(F.sum("_size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    summed = shifted(sized.withColumn("_in", within), F.sum("_size"), "before", "_in")
    return summed.select(dialogue, order, "position", "value", "before")


def da_sequence(t, da="da_label", order="idx", block=ROWS_PER_BLOCK):
    """Acts of every conversation in file order, one row each; a missing act is an empty text."""
    listed = _listed(t, F.coalesce(F.col(da), F.lit("")), "dialogue_id", order, block)
    return listed.select("dialogue_id", F.col("_list").alias("da_sequence"))


def conversation_outcome(t, pr="pr_label"):
    """Outcome, length and label set of every conversation.

    A single label is the outcome (Neutral means none); otherwise both outcomes make a Conflict.
    """
    seen = t.groupBy("dialogue_id").agg(
        F.coalesce(F.bool_or(F.col(pr) == "Compliance"), F.lit(False)).alias("_c"),
        F.coalesce(F.bool_or(F.col(pr) == "Resistance"), F.lit(False)).alias("_r"),
        rows_n().alias("utterance_count"), F.count(pr).alias("_labelled"),
        F.array_sort(F.collect_set(pr)).alias("unique_labels"))
    single = (F.size("unique_labels") == 1) & (F.col("_labelled") == F.col("utterance_count"))
    only = F.get("unique_labels", F.lit(0))
    outcome = (F.when(single & (only != "Neutral"), only)
               .when(single, F.lit(None))
               .when(F.col("_c") & F.col("_r"), "Conflict")
               .when(F.col("_c"), "Compliance").when(F.col("_r"), "Resistance"))
    return seen.select("dialogue_id", outcome.alias("outcome"), "utterance_count", "unique_labels")


def dialogue_context(t, text="sentence", order="idx", block=ROWS_PER_BLOCK):
    """All non-empty sentences of a dialogue, one per line, in file order; one row per dialogue."""
    spoken = t.where(F.trim(F.col(text)) != "")
    listed = _listed(spoken, F.trim(F.col(text)), "dialogue_id", order, block)
    return listed.select("dialogue_id", F.array_join("_list", "\n").alias("context"))


MOST_PROMPT_CHARS = 1 << 28


def conversation_prompts(t, ask, text="sentence", speaker="role", order="idx", most=MOST_PROMPT_CHARS,
                         block=ROWS_PER_BLOCK):
    """One prompt per dialogue: its utterances, numbered from 1 in file order, and what is asked of each.

    Also the list ``places`` of the utterances' file positions, for ``replies_per_row``. Output grows with the
    input, where a prompt for each row with the whole context would grow with its square. A prompt of more than
    ``most`` characters raises; nothing is cut.
    """
    line = F.struct(F.col(order).alias("at"), F.concat(
        F.lit(" ("), F.coalesce(F.col(speaker).cast("string"), F.lit("")), F.lit("): "),
        F.coalesce(F.col(text), F.lit(""))).alias("line"))
    listed = _listed(t, line, "dialogue_id", order, block)
    lines = F.transform("_list", lambda r, i: F.concat((i + 1).cast("string"), r["line"]))
    prompt = F.array_join(F.array_append(lines, F.lit(ask)), "\n")
    made = listed.select("dialogue_id", prompt.alias("prompt"), F.transform("_list", lambda r: r["at"]).alias("places"))
    whole = F.when(F.length("prompt") <= most, F.col("prompt")).otherwise(
        F.raise_error(F.concat(F.lit("prompt too long in dialogue "), F.col("dialogue_id").cast("string"))))
    return made.withColumn("prompt", whole)


MOST_PART_CHARS = 1 << 16


def dialogue_parts(t, line, most=MOST_PART_CHARS, dialogue="dialogue_id", order="idx", block=ROWS_PER_BLOCK):
    """Lines of a dialogue packed in order into parts of at most ``most`` characters: (dialogue, part, body, places).

    ``line`` is a function of the value column's row position (from 0) and gives the line's text; lines of a part are
    joined by a line break. A line belongs to the part that its first character falls in when the dialogue's characters are
    counted off by half of ``most``, so parts are found by sums alone and are at least half full on average. A line of more
    than half of ``most`` goes on in the next parts: joined without a break, its pieces are the line. ``places`` lists
    the ``order`` of the lines that begin in the part. Parts are numbered from 0 without gaps. Nothing is dropped, and no
    cell is longer than a part but for a line itself.
    """
    if most < 4:
        raise ValueError("a part takes at least 4 characters")
    half = most // 2
    room = half - 1  # of a piece; its line break is counted with it
    pieces_of = lambda text: F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(room)))
    size = lambda v, p: F.length(line(v, p)) + pieces_of(line(v, p))
    fields = F.struct(*[F.col(c) for c in t.columns])
    rows = long_form(t, fields, dialogue, order, size, block)
    whole = line(F.col("value"), F.col("position"))
    # one pass over a line, where a substring for each piece would read a long line once a piece
    pieces = F.when(whole == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{room}}}"), F.lit(0)))
    cut = rows.select(dialogue, order, "before", F.posexplode(pieces).alias("_piece", "_text"))
    start = F.col("before") + F.col("_piece") * half
    parts = cut.groupBy(dialogue, F.floor(start / half).alias("part")).agg(
        _in_order(order, "_piece", "_text").alias("_rows"))
    begins = F.transform(F.filter("_rows", lambda r: r["_piece"] == 0), lambda r: r["_o"])
    # a piece that continues a line opens its part, so a break between two pieces of one part never falls inside a line
    return parts.select(dialogue, "part", F.array_join(F.transform("_rows", lambda r: r["_text"]), "\n").alias("body"),
                        begins.alias("places"))


def prompt_parts(t, ask, text="sentence", speaker="role", order="idx", most=MOST_PART_CHARS, block=ROWS_PER_BLOCK):
    """``conversation_prompts`` in parts: (dialogue, part, prompt, places), each prompt of at most ``most`` characters.

    Utterances keep their numbers in the whole dialogue; what is asked ends every part. ``replies_per_row`` takes the replies
    of all parts together. A dialogue of any size has its parts; nothing is cut off and nothing raises.
    """
    def line(v, position):
        return F.concat((position + 1).cast("string"), F.lit(" ("), F.coalesce(v[speaker].cast("string"), F.lit("")),
                        F.lit("): "), F.coalesce(v[text], F.lit("")))
    spoken = t.select("dialogue_id", *dict.fromkeys([order, speaker, text]))
    parts = dialogue_parts(spoken, line, most - len(ask) - 1, order=order, block=block)
    return parts.select("dialogue_id", "part", F.concat("body", F.lit("\n" + ask)).alias("prompt"), "places")


def context_parts(t, text="sentence", order="idx", most=MOST_PART_CHARS, block=ROWS_PER_BLOCK):
    """``dialogue_context`` in parts of at most ``most`` characters: (dialogue, part, body, places)."""
    spoken = t.where(F.trim(F.col(text)) != "").select("dialogue_id", order, F.trim(F.col(text)).alias(text))
    return dialogue_parts(spoken, lambda v, p: v[text], most, order=order, block=block)


def replies_per_row(prompts, reply="reply", separator=",", order="idx"):
    """(dialogue, position, answer): the n-th answer of a reply list goes to the n-th utterance; missing ones are NULL."""
    answers = F.split(reply, separator)
    rows = prompts.select("dialogue_id", answers.alias("_a"), F.posexplode("places").alias("_i", order))
    return rows.select("dialogue_id", order, F.trim(F.get("_a", F.col("_i"))).alias("answer"))


def build_prompt(t, template, name="prompt"):
    """Fill ``{column}`` places of a template; a missing value becomes an empty text."""
    pieces = re.split(r"\{(\w+)\}", template)
    filled = [F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p)
              for i, p in enumerate(pieces)]
    return t.withColumn(name, F.concat(*filled))


def complete_turns(t, roles=2):
    """Rows of the (dialogue, turn) pairs in which exactly so many roles speak."""
    spoken = F.size(F.collect_set("role").over(W.partitionBy("dialogue_id", "turn")))
    return t.withColumn("_roles", spoken).where(F.col("_roles") == roles).drop("_roles")


def sample_turns(t, n, seed=42):
    """Rows of n complete turns, the same draw however the table is partitioned.

    Turns are drawn in the order of a digest of their key; only the n smallest are kept and sorted.
    """
    whole = complete_turns(t)
    keys = whole.groupBy("dialogue_id", "turn").agg(rows_n().alias("_n")).drop("_n")
    digest = F.md5(F.concat_ws(":", "dialogue_id", "turn", F.lit(seed)))
    drawn = least_rows(keys.withColumn("_of", F.struct("dialogue_id", "turn")), digest, "_of", n).drop("_of")
    return whole.join(drawn, ["dialogue_id", "turn"], "left_semi")


def corpus_profile(t):
    """Rows, dialogues, (dialogue, turn) pairs and rows per role."""
    turns = t.groupBy("dialogue_id", "turn").agg(
        rows_n().alias("rows"), F.count_if(F.col("role") == 0).alias("rows_role_0"),
        F.count_if(F.col("role") == 1).alias("rows_role_1"))
    dialogues = turns.groupBy("dialogue_id").agg(
        *[F.sum(c).alias(c) for c in ("rows", "rows_role_0", "rows_role_1")], rows_n().alias("turns"))
    return dialogues.agg(F.sum("rows").alias("rows"), rows_n().alias("dialogues"),
                         F.sum("turns").alias("turns"), F.sum("rows_role_0").alias("rows_role_0"),
                         F.sum("rows_role_1").alias("rows_role_1"))
