"""Quotation linking: who quotes whom, and each conversation in reply order without its quotes.

Only DataFrame functions. A line's quote level is its number of leading ``>``. Neighbouring lines
of one level make a passage; blank lines and changes of level end it. A passage is compared by
the hash of its words in lower case, single-spaced, so re-wrapping, case and quote marks don't
matter. Every quoted passage looks up the latest earlier message of its conversation that has
it as a passage or as a line of its own (unquoted) words. A passage without one was trimmed: it looks
up the latest earlier message that has its words as a run inside an own passage, be it some of the
lines or a part of one. A message replies to the source of its shallowest linked quote, of several to
the latest.

Defined results: a null or empty text has no passages and stays as it is; a quote without words
is dropped and links nothing; a quote whose source isn't found is dropped from the text all the
same; messages of one (conversation, turn) count as one place for links and each keep their
row; a message without conversation or turn links nothing; a message without links starts its own
thread; other columns pass through, and one that has the name of a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.asof import last_before
from watchloom.llm.binding import bound, restore, shield
from watchloom.session import materialize, materialize_counted

_CUT, _PART = "\x01", "\x02"


def _lines(text: Column) -> Column:
    """Array of (level, body) per line."""
    clean = F.translate(text, _CUT + _PART, "  ")

    def parse(line):
        mark = F.regexp_extract(line, r"^((?:[ \t]*>)*)", 1)
        return F.struct(
            (F.length(mark) - F.length(F.translate(mark, ">", ""))).alias("level"),
            F.btrim(F.substring(line, F.length(mark) + 1, F.length(line)), F.lit(" \t\r")).alias("body"),
        )

    return F.transform(F.split(clean, "\n"), parse)


def _norm(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(body), r"\s+", " "))


def _worded(lines: Column) -> Column:
    """Array of (level, norm): the passages with a word, in order."""

    def piece(ls, x, i):
        before = F.get(ls, i - 1)
        starts = (i == 0) | (x["level"] != before["level"]) | (before["body"] == "")
        return F.concat(F.when(starts, F.concat(F.lit(_CUT), x["level"].cast("string"), F.lit(_PART))).otherwise(" "), x["body"])

    joined = bound(lines, lambda ls: F.array_join(F.transform(ls, lambda x, i: piece(ls, x, i)), ""))
    split = F.transform(
        F.split(joined, _CUT),
        lambda p: F.struct(F.substring_index(p, _PART, 1).try_cast("int").alias("level"), _norm(F.substring_index(p, _PART, -1)).alias("norm")),
    )
    return F.filter(split, lambda p: (p["norm"] != "") & p["level"].isNotNull())


def _passages(lines: Column) -> Column:
    """Array of (level, h, m): hash and number of words of the passages with a word, in order."""
    return F.transform(_worded(lines), lambda p: F.struct(p["level"].alias("level"), F.md5(p["norm"]).alias("h"), F.size(F.split(p["norm"], " ")).alias("m")))


def _marks(text: Column) -> Column:
    """Distinct (level, h, m, passage): own passages and own lines at level 0, quoted passages above, one row each."""

    def of(ls):
        own_lines = F.transform(F.filter(ls, lambda x: (x["level"] == 0) & (_norm(x["body"]) != "")), lambda x: F.struct(F.lit(0).alias("level"), F.md5(_norm(x["body"])).alias("h"), F.size(F.split(_norm(x["body"]), " ")).alias("m")))
        both = bound(_passages(ls), lambda ps: F.concat(F.filter(ps, lambda p: p["level"] > 0), F.array_distinct(F.concat(F.filter(ps, lambda p: p["level"] == 0), own_lines))))
        return F.transform(both, lambda p, i: F.struct(p["level"].alias("level"), p["h"].alias("h"), p["m"].alias("m"), i.alias("k")))

    return bound(_lines(text), of)


def unquoted(text: Column) -> Column:
    """The text without quoted lines and without blank lines at its ends."""
    own = F.filter(F.split(text, "\n"), lambda x: ~F.regexp_like(x, F.lit(r"^[ \t]*>")))
    return F.when(F.regexp_like(text, F.lit(r"(?:^|\n)[ \t]*>")), F.btrim(F.array_join(own, "\n"), F.lit("\r\n"))).otherwise(text)


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``k``, ``level``, ``source``: each quoted passage and the turn that it comes from, or null."""
    base = messages.select(messages[f"`{conv}`"].alias("conv"), messages[f"`{turn}`"].alias("turn"), messages[f"`{text}`"].cast("string").alias("t"))
    base = base.filter("conv is not null and turn is not null and t is not null")
    marks = base.select("conv", "turn", F.explode(_marks(F.col("t"))).alias("m")).select("conv", "turn", "m.*")
    # At one turn quotes come first: a message is a source for later turns only. The passage's
    # place and level make rows of one message apart.
    rows = marks.withColumns({"side": (F.col("level") == 0).cast("int"), "at": F.col("turn")})
    seen = last_before(rows, ["conv", "h"], ["turn", "side", "level", "k"], F.col("level") == 0, "at")
    quotes = seen.filter("level > 0").select("conv", "turn", "k", "level", "h", "m", F.col("found").alias("source"))
    trimmed, n, _ = materialize_counted(quotes.filter("source is null").drop("source"), "trimmed")
    found = quotes.filter("source is not null").select("conv", "turn", "k", "level", "source")
    return found.union(_trimmed_links(base, trimmed)) if n else found


def _trimmed_links(base: DataFrame, trimmed: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``k``, ``level``, ``source`` of the passages that no message has as a whole.

    Own passages of their conversations are cut into the runs of as many words as such a passage
    has; only runs that a passage asks for are kept.
    """
    lengths = trimmed.select("conv", "m").distinct().groupBy("conv").agg(F.collect_list("m").alias("ms"))
    own = base.join(lengths, "conv").select("conv", "turn", "ms", F.explode(F.filter(_worded(_lines(F.col("t"))), lambda p: p["level"] == 0)).alias("p"))
    words = own.select("conv", "turn", "ms", F.split("p.norm", " ").alias("w"))
    sized = words.select("conv", "turn", "w", F.explode(F.filter("ms", lambda m: m <= F.size("w"))).alias("m"))
    starts = sized.select("conv", "turn", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i"))
    runs = starts.select("conv", "turn", F.md5(F.array_join(F.slice("w", F.col("i"), F.col("m")), " ")).alias("h"))
    sources = runs.join(trimmed.select("conv", "h").distinct(), ["conv", "h"], "left_semi").distinct()
    both = trimmed.select("conv", "turn", "h", "level", "k").union(sources.select("conv", "turn", "h", F.lit(0), F.lit(0)))
    rows = both.withColumns({"side": (F.col("level") == 0).cast("int"), "at": F.col("turn")})
    seen = last_before(rows, ["conv", "h"], ["turn", "side", "level", "k"], F.col("level") == 0, "at")
    return seen.filter("level > 0").select("conv", "turn", "k", "level", F.col("found").alias("source"))


def threads(links: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``root``, ``depth`` of every turn with a ``parent``, by pointer doubling.

    Parents are earlier turns, so the pointers end; rounds are the logarithm of the longest chain,
    and finished turns are set aside.
    """
    spark = links.sparkSession
    moving, n, _ = materialize_counted(links.select("conv", "turn", F.col("parent").alias("to"), F.lit(1).cast("long").alias("steps")), "pointers")
    done = None
    while n:
        ahead = moving.select(F.col("conv").alias("c"), F.col("turn").alias("at"), F.col("to").alias("next"), F.col("steps").alias("more"))
        now = moving.join(ahead, (moving["conv"] == ahead["c"]) & (moving["to"] == ahead["at"]), "left")
        stepped = now.select("conv", "turn", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNull().alias("ended"))
        if done is not None:
            # A pointer at a finished turn takes that turn's root.
            tops = done.select(F.col("conv").alias("c2"), F.col("turn").alias("at2"), F.col("to").alias("top"), F.col("steps").alias("rest"))
            stepped = stepped.join(tops, (stepped["conv"] == tops["c2"]) & (stepped["to"] == tops["at2"]), "left").select(
                "conv", "turn", F.coalesce("top", "to").alias("to"), (F.col("steps") + F.coalesce("rest", F.lit(0))).alias("steps"), (F.col("ended") | F.col("top").isNotNull()).alias("ended")
            )
        step = materialize(stepped, "pointers")
        ended = step.filter("ended").drop("ended")
        done = ended if done is None else done.union(ended)
        moving, n, _ = materialize_counted(step.filter("not ended").drop("ended"), "pointers")
    if done is None:
        done = moving
    return done.select("conv", "turn", F.col("to").alias("root"), F.col("steps").alias("depth"))


def reply_order(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``messages`` without quotes, with ``reply_to``, ``thread`` (the first turn of its thread), ``depth``, ``n_quotes``, ``n_linked``; in order of conversation, thread and turn."""
    links = materialize(link_quotes(messages, conv, turn, text), "links")
    linked = F.col("source").isNotNull()
    per_turn = links.groupBy("conv", "turn").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.sum(linked.cast("long")).alias("n_linked"),
        F.max(F.when(linked, F.struct((-F.col("level")).alias("l"), F.col("source").alias("source"))))["source"].alias("parent"),
    )
    per_turn = materialize(per_turn, "replies")
    roots = threads(per_turn.filter("parent is not null"))
    facts = per_turn.join(roots, ["conv", "turn"], "left")
    inner, at = shield(messages)
    met = inner.join(facts, (at[conv] == F.col("conv")) & (at[turn] == F.col("turn")), "left")
    results = {
        text: unquoted(at[text].cast("string")),
        "reply_to": F.col("parent"),
        "thread": F.coalesce("root", at[turn]),
        "depth": F.coalesce("depth", F.lit(0)).cast("long"),
        "n_quotes": F.coalesce("n_quotes", F.lit(0)).cast("long"),
        "n_linked": F.coalesce("n_linked", F.lit(0)).cast("long"),
    }
    return restore(met, at, **results).orderBy(conv, "thread", turn)


def with_quotes(conversations: DataFrame) -> DataFrame:
    """The conversations as a mail thread would hold them.

    Odd turns quote the message before with wider spaces, every third one its first line only, every
    fourth one the message two before, at two levels.
    """
    base = conversations.select("conv_id", "turn", "role", "text")
    past = lambda d, name: base.groupBy("conv_id", (F.col("turn") + d).alias("turn")).agg(F.min("text").alias(name))
    quoted = lambda marks, t: F.concat(F.lit(marks), F.regexp_replace(t, "\n", "\n" + marks), F.lit("\n\n"))
    told = base.join(past(1, "before"), ["conv_id", "turn"], "left").join(past(2, "earlier"), ["conv_id", "turn"], "left")
    turn = F.col("turn")
    deep = F.when((turn % 4 == 3) & F.col("earlier").isNotNull(), quoted("> > ", F.col("earlier"))).otherwise("")
    near = F.when(F.col("before").isNull(), "").when(turn % 3 == 2, quoted("> ", F.substring_index("before", "\n", 1))).when(turn % 2 == 1, quoted("> ", F.replace(F.col("before"), F.lit(" "), F.lit("  ")))).otherwise("")
    return told.select("conv_id", "turn", "role", F.concat(deep, near, F.col("text")).alias("text"))


def op4_quote_links(spark, sf_dir: str) -> DataFrame:
    """One row per message of the quoting conversations: links, thread and digest of its own words."""
    out = reply_order(with_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return out.select("conv_id", "turn", "role", "reply_to", "thread", "depth", "n_quotes", "n_linked", F.sha2("text", 256).alias("text_sha256"))


OP4_SQL = r"""
with recursive told as (
  select c.conv_id, c.turn, c.role,
         case when c.turn % 4 = 3 and e.text is not null then '> > ' || replace(e.text, chr(10), chr(10) || '> > ') || chr(10) || chr(10) else '' end
         || case when b.text is null then ''
                 when c.turn % 3 = 2 then '> ' || split_part(b.text, chr(10), 1) || chr(10) || chr(10)
                 when c.turn % 2 = 1 then '> ' || replace(replace(b.text, ' ', '  '), chr(10), chr(10) || '> ') || chr(10) || chr(10)
                 else '' end || c.text as text
  from conversations c
  left join (select conv_id, turn + 1 turn, min(text) text from conversations group by 1, 2) b using (conv_id, turn)
  left join (select conv_id, turn + 2 turn, min(text) text from conversations group by 1, 2) e using (conv_id, turn)),
l as (
  select conv_id, turn, i, length(mark) - length(replace(mark, '>', '')) lev, trim(substring(line, length(mark) + 1), ' ' || chr(9) || chr(13)) body
  from (select *, regexp_extract(line, '^((?:[ \t]*>)*)', 1) mark
        from (select conv_id, turn, unnest(string_split(text, chr(10))) line, unnest(generate_series(1, len(string_split(text, chr(10))))) i from told))),
g as (
  select *, sum(starts) over (partition by conv_id, turn order by i) p
  from (select *, case when lag(lev) over w is null or lag(lev) over w <> lev or lag(body) over w = '' then 1 else 0 end starts
        from l window w as (partition by conv_id, turn order by i))),
pas as (
  select conv_id, turn, p, min(lev) lev, trim(regexp_replace(lower(string_agg(body, ' ' order by i)), '\s+', ' ', 'g')) norm
  from g group by 1, 2, 3),
own as (
  select conv_id, turn, norm from pas where lev = 0 and norm <> ''
  union select conv_id, turn, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) from l where lev = 0),
src as (
  select q.conv_id, q.turn, q.p, q.lev, max(o.turn) source
  from pas q left join own o on o.conv_id = q.conv_id and o.norm = q.norm and o.turn < q.turn
  where q.lev > 0 and q.norm <> '' group by 1, 2, 3, 4),
per as (
  select conv_id, turn, count(*) n_quotes, count(source) n_linked,
         max(case when source is not null then struct_pack(l := -lev, s := source) end) best
  from src group by 1, 2),
up as (select conv_id, turn, n_quotes, n_linked, best.s parent from per),
walk as (
  select conv_id, turn, parent at_, 1 depth from up where parent is not null
  union all select w.conv_id, w.turn, u.parent, w.depth + 1 from walk w join up u on u.conv_id = w.conv_id and u.turn = w.at_ where u.parent is not null),
top as (select conv_id, turn, min(at_) root, max(depth) depth from walk group by 1, 2)
select t.conv_id, t.turn, t.role, parent reply_to, coalesce(root, t.turn) thread, coalesce(depth, 0) depth,
       coalesce(n_quotes, 0) n_quotes, coalesce(n_linked, 0) n_linked,
       sha256(case when regexp_matches(text, '(^|\n)[ \t]*>')
         then trim(list_aggregate(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '^[ \t]*>')), 'string_agg', chr(10)), chr(13) || chr(10))
         else text end) text_sha256
from told t left join up using (conv_id, turn) left join top using (conv_id, turn)
"""
