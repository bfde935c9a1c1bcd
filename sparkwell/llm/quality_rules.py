"""Line-first cleaning in DataFrame functions: rules by line, then a verdict on what is left of the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Marks that seldom stand in prose; a line in which they are over a tenth of the characters fails.
SYMBOLS = r"[^#*$%&|<>{}^~=_\\]+"
#: Separators of menus and link lists.
SEPARATORS = r"[|»›•·→]"
#: Marks put twice or more.
SHOUTS = r"[!?][!?]+"
#: What a sentence or a list's head ends with.
SENTENCE_END = r"[.!?:;…\"')\]»”’。！？][\x20\x09-\x0D]*$"
#: One to three words alone.
FRAGMENT = r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+([\x20\x09-\x0D]+[^\x20\x09-\x0D]+)?([\x20\x09-\x0D]+[^\x20\x09-\x0D]+)?[\x20\x09-\x0D]*$"
#: Short lines that only lead elsewhere.
NAVIGATION = r"(?i)(click here|read more|sign in|log in|sign up|skip to (main )?content|back to top|share (this|on)|follow us|next page|previous page|site map|mehr lesen|weiterlesen|anmelden|lire la suite|se connecter|leer m.s|iniciar sesi.n)"
#: Short lines on rights, licences, cookies and the like.
BOILERPLATE = r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|uses cookies|enable javascript|lorem ipsum|licensed under|released under the .+ licen[cs]e|copyright (©|\(c\)|[0-9][0-9][0-9][0-9])|subscribe to our newsletter|alle rechte vorbehalten|tous droits r.serv.s|todos los derechos reservados|datenschutzerkl.rung|mentions l.gales|politique de confidentialit.|pol.tica de privacidad)"
SHORT_LINE, MAX_SHARE_LOST = 200, 60


def _bare(x: Column) -> Column:
    return F.length(F.regexp_replace(x, SPACE, ""))


def _fails(line: Column) -> Column:
    """Whether a line breaks a punctuation, navigation or boilerplate rule."""
    size = F.length(line)
    marks = F.regexp_count(line, F.lit(SHOUTS))
    bars = F.regexp_count(line, F.lit(SEPARATORS))
    short = size <= SHORT_LINE
    return (
        (F.length(F.regexp_replace(line, SYMBOLS, "")) * 10 > size)
        | ((marks >= 2) & (marks * 20 >= size))
        | ((bars >= 2) & (bars * 30 >= size))
        | (short & ~line.rlike(SENTENCE_END) & line.rlike(FRAGMENT))
        | (short & (line.rlike(NAVIGATION) | line.rlike(BOILERPLATE)))
    )


def line_first(docs: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, max_lost_percent: int = MAX_SHARE_LOST) -> DataFrame:
    """doc_id, measures of the whole text, the verdict ``kept`` and ``text`` without the lines that failed.

    Measures: n_words (runs of other than ASCII white space), word_chars (code points in words), n_symbols (``#*$%&|<>``), n_dup_lines
    (lines with a word that equal an earlier one), n_repeat_words (words inside 5-word windows that come twice or more),
    base_failed (too few words, or too many repeated), n_lines, n_lines_failed, lost_chars (code points of failed lines'
    words). kept: not base_failed, and at most ``max_lost_percent`` of word_chars lost. Windows are compared by a 64-bit hash
    of their words' 64-bit hashes.

    Null text counts as empty: all measures 0, base_failed, not kept. Rows are judged one by one, so repeated rows, null
    ids and empty tables need no care; other columns of ``docs`` aren't read. Arrays of a row grow with its text alone.
    """
    w = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    w = w.select("doc_id", "t", F.array_remove(F.split("t", SPACE), "").alias("w"))
    lines = F.split("t", "\n")
    w = w.select(
        "doc_id",
        "t",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    window = F.transform(F.slice("h", F.lit(1), F.size("h") - 4), lambda x, i: F.xxhash64(x, *(F.get("h", i + k) for k in range(1, 5))))
    w = w.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(x.alias("line"), _fails(x).alias("bad"))).alias("lines"),
        F.when(F.size("h") >= 5, window).otherwise(F.array().cast("array<bigint>")).alias("win"),
    )
    # the long way only for texts that repeat a window: windows in order of their hash, so that equal ones are neighbours
    again = F.size(F.array_distinct("win")) < F.size("win")
    in_order = F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    w = w.withColumn("s", F.when(again, in_order)).drop("win")
    same = lambda x, i: F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False))
    w = w.withColumn("p", F.sort_array(F.transform(F.filter("s", same), lambda x: x["p"]))).drop("s")
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.coalesce(F.get("p", i + 1) - x, F.lit(5)), F.lit(5))), F.lit(0), lambda a, x: a + x)
    w = w.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")
    bad = F.filter("lines", lambda x: x["bad"])
    w = w.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_lines_failed", F.size(bad).cast("long"))
    w = w.withColumn("lost_chars", F.aggregate(bad, F.lit(0), lambda a, x: a + _bare(x["line"])).cast("long"))
    w = w.withColumn("text", F.array_join(F.transform(F.filter("lines", lambda x: ~x["bad"]), lambda x: x["line"]), "\n")).drop("lines")
    w = w.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    return w.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost_percent * F.col("word_chars")))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_failed", "lost_chars"]


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as k from documents),
w as (select k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
win as (select k, unnest(range(1, len(w) - 3)) as p, w from w where len(w) >= 5),
hashed as (select k, p, array_to_string(w[p:p + 4], ' ') as x from win),
twice as (select k, p from (select k, p, count(*) over (partition by k, x) as n from hashed) where n > 1),
cover as (select k, sum(least(5, coalesce(nxt - p, 5))) as n from (select k, p, lead(p) over (partition by k order by p) as nxt from twice) group by k),
line as (select k, unnest(string_split(t, chr(10))) as x from d),
worded as (select k, x, regexp_replace(x, {_q(SPACE)}, '', 'g') as bare,
    length(regexp_replace(x, {_q(SYMBOLS)}, '', 'g')) * 10 > length(x)
    or (len(regexp_extract_all(x, {_q(SHOUTS)})) >= 2 and len(regexp_extract_all(x, {_q(SHOUTS)})) * 20 >= length(x))
    or (len(regexp_extract_all(x, {_q(SEPARATORS)})) >= 2 and len(regexp_extract_all(x, {_q(SEPARATORS)})) * 30 >= length(x))
    or (length(x) <= {SHORT_LINE} and not regexp_matches(x, {_q(SENTENCE_END)}) and regexp_matches(x, {_q(FRAGMENT)}))
    or (length(x) <= {SHORT_LINE} and (regexp_matches(x, {_q(NAVIGATION)}) or regexp_matches(x, {_q(BOILERPLATE)}))) as bad
  from line where regexp_matches(x, '[^\x20\x09-\x0D]')),
lines as (select k, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines, count(*) filter (bad) as n_lines_failed, coalesce(sum(length(bare)) filter (bad), 0) as lost_chars from worded group by k),
m as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(cover.n, 0)::bigint as n_repeat_words,
    coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_lines_failed, 0)::bigint as n_lines_failed, coalesce(lost_chars, 0)::bigint as lost_chars
  from d join w using (k) left join lines using (k) left join cover using (k))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * lost_chars <= {MAX_SHARE_LOST} * word_chars as kept, n_lines, n_lines_failed, lost_chars
from m
"""
