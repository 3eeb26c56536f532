"""Problem 3: text values that stop before they were finished.

What the corpus itself says is the evidence, over all values: its vocabulary as a trie (a table of nodes, one for each
prefix of a known word), the words that make up finished sentences against those of lines that never end in a full
stop (headlines, credits, link lines, lists), and the lengths at which unfinished values pile up. A value is truncated

- if a mark of a cut follows it,
- if its last sentence ends in a bare number that is no year, or in an initial: the rest of the figure or name is gone,
- if it has no end mark and its final token is a proper prefix of known words and itself none, or far rarer than they,
- if it has no end mark and its last line reads as a sentence rather than as a line without a full stop; a length at
  which values pile up counts for a cut.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.sitelines import letters
from newsloom.llm.values import BLANKS, STAND_INS, is_stand_in, says_something
from newsloom.session import sealed, stage

# What is put after a text that was cut.
CUT_MARK = r"(?i)(?:…|\.\.\.+|\[\s*(?:…|\.\.\.)\s*\]|\((?:more|cont\.?|continued)\)|\b(?:read more|continue reading))[\s ]*$"
END_MARK = r"[.!?。！？»)\]}\"”’'…][\s ]*$"
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"
# TOKEN without hyphens and apostrophes at its end.
_TOKEN = regex.compile(r"[\p{L}\p{N}]+(?:['’-]+[\p{L}\p{N}]+)*")
_ASCII = {i: " " for i in range(128) if not (chr(i).isalnum() or chr(i) in "'-")}
# What CUT_MARK (but for dots) and END_MARK end in, looked at before they are tried, and the line ends that `$` overlooks.
_MARK_ENDS, _END_MARKS, _LINE_ENDS = ("…", "]", ")", "e", "E", "g", "G"), tuple(".!?。！？»)]}\"”’'…"), ("\u0085", "\u2028", "\u2029")
_ENDED = tuple(".!?。！？)\"”»…")
_OTHER_MARK = regex.compile(CUT_MARK.replace(r"…|\.\.\.+|", "", 1))
_SPACES = "".join(c for c in map(chr, range(0x3001)) if regex.match(r"\s", c))
# Fixed value: what stands between the entries of a list that is written as one line.
ENTRY_MARKS = ("·", "|", "•")
_ENTRY_PY = regex.compile(r" *[·|•] *")
# The least a line, a closing line and a length are met before anything is read into them. These only keep chance out of
# small tables: what decides are the ratios below and between neighbouring lengths, which don't change with size.
KNOWN_LINE_CHARS, KNOWN_LINE_TIMES, KNOWN_LAST_TIMES, PILE_TIMES = 120, 3, 5, 8
GOES_ON = 0.1  # a line that stands complete is the start of a longer one at most so often for each time it stands alone
FAR_RARER = 2000  # a token is no known word if those that go on from it are so many times as frequent
STAND_IN_BYTES = 4 * max(len(x.encode()) for x in STAND_INS)  # a longer text is no stand-in: lower case takes a byte for each four at least
KEY_LETTERS = 8  # lines that share so many letters at the start are compared as a whole
END_CHARS = 200  # marks and the final token are looked for in so many characters at the end; no word is longer
SMOOTH = 0.5
HELD_COUNTS = 1_000_000  # a task's counts before they are handed on
PILE_BONUS = 3.0


def _tokens(line: str) -> list[str]:
    if not line.isascii():
        found = _TOKEN.findall(line)
        return "\n".join(found).casefold().split("\n") if found else []
    words = line.lower().translate(_ASCII).split()
    return [w for w in (x.strip("-'") for x in words) if w] if "-" in line or "'" in line else words


def _mark_at(body: str) -> int | None:
    """Where CUT_MARK is met in a line without the blanks behind it. Only the end is looked at, so dots within a line cost nothing."""
    if body.endswith("..."):
        return len(body.rstrip("."))
    if body.endswith("…"):
        return len(body) - 1
    mark = _OTHER_MARK.search(body) if body.endswith(_MARK_ENDS) else None
    return mark.start() if mark else None


def _features(tokens: list[str]) -> list[str]:
    words = ["0" if t[0].isdigit() else t for t in tokens]
    return words + [f"{a} {b}" for a, b in zip(["^", *words], words)]


def _rows(known: Counter, kinds: dict[str, Counter]) -> pd.DataFrame:
    rows = [("v", w, n) for w, n in known.items() if w] + [(k, f, n) for k, c in kinds.items() for f, n in c.items()]
    return pd.DataFrame(rows, columns=["kind", "token", "n"])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts over a task, handed on whenever HELD_COUNTS have gathered: v known words (the final token of a value or before a mark of a cut may be no whole word), s words of
    finished sentences, l words of lines without an end mark, k short lines that are complete."""
    known: Counter = Counter()
    kinds: dict[str, Counter] = {"s": Counter(), "l": Counter(), "k": Counter()}
    for pdf in batches:
        if len(known) + sum(map(len, kinds.values())) > HELD_COUNTS:
            yield _rows(known, kinds)
            for c in (known, *kinds.values()):
                c.clear()
        for value, is_title in zip(pdf["value"], pdf["is_title"]):
            if is_stand_in(value):
                continue
            lines = [x for x in value.split("\n") if x.strip()]
            for k, line in enumerate(lines):
                last = k == len(lines) - 1
                body = line.rstrip(_SPACES)
                ended = body.endswith(_ENDED)
                mark = _mark_at(body)
                if mark is not None:  # what stands before a mark may be half a word
                    known.update(_tokens(line[:mark])[:-1])
                    continue
                tokens = _tokens(line)
                known.update(tokens[:-1] if last and not is_title else tokens)
                if not tokens:
                    continue
                if (ended or not last) and not is_title and len(line) <= KNOWN_LINE_CHARS:
                    kinds["k"][letters(_ENTRY_PY.split(line.strip())[-1])] += 1
                if is_title or (not ended and not last):
                    kinds["l"].update(_features(tokens))
                elif ended:
                    kinds["s"].update(_features(tokens))
    yield _rows(known, kinds)


def corpus_counts(values: DataFrame, titles: DataFrame) -> DataFrame:
    """(kind, token, n) over all values and titles; partial sums leave each task, so the shuffle carries vocabulary."""
    texts = values.select("value", F.lit(False).alias("is_title")).unionByName(titles.select("value", F.lit(True).alias("is_title")))
    parts = texts.where(F.col("value").isNotNull()).mapInPandas(_count, "kind string, token string, n bigint")
    return parts.groupBy("kind", "token").agg(F.sum("n").alias("n"))


def _casefold(c: Column) -> Column:
    return F.lower(c)


def _figure(c: Column) -> Column:
    return F.when(c.rlike(r"^[^\p{L}]*\p{N}"), "0").otherwise("")


def _lead(c: Column, n_chars: int, n_letters: int) -> Column:
    """The first letters of a line, after a 0 if a figure stands before them."""
    c = F.left(F.ltrim(c, F.lit(BLANKS)), F.lit(n_chars))
    return F.left(F.concat(_figure(c), _casefold(F.regexp_replace(c, r"[^\p{L}]+", ""))), F.lit(n_letters))


def goes_on(values: DataFrame, openings: DataFrame) -> DataFrame:
    """(opening, longer): how many lines and list entries of values(value) begin as an opening does and go on.

    openings(opening) is a written table of distinct strings as `_lead` makes them. Lines are folded to their first
    letters, those that begin like a long opening to all letters that matter, and met by the power of two below an
    opening's length, so neither common first letters nor common lines are compared one by one.
    """
    pieces = values.select(F.explode(F.split("value", r"[\n·|•]")).alias("x"))
    x, n_chars = F.col("x"), 2 * KNOWN_LINE_CHARS
    keyed = pieces.select("x", sealed(_lead(x, 4 * KEY_LETTERS, KEY_LETTERS)).alias("key"))
    keyed = keyed.select("x", sealed(F.when((F.length("key") < KEY_LETTERS) & (F.length(x) > 4 * KEY_LETTERS), _lead(x, n_chars, KEY_LETTERS)).otherwise(F.col("key"))).alias("key"))
    hot = openings.where(F.length("opening") >= KEY_LETTERS).select(F.left("opening", F.lit(KEY_LETTERS)).alias("key")).distinct().withColumn("hot", F.lit(True))
    start = F.when(F.col("hot"), _lead(x, n_chars, KNOWN_LINE_CHARS + 2)).otherwise(F.col("key"))
    starts = keyed.where(F.col("key") != "").join(hot, "key", "left").groupBy(start.alias("start")).agg(F.count("*").alias("n"))
    levels = [1 << k for k in range(KNOWN_LINE_CHARS.bit_length())]
    met = starts.select("start", "n", F.explode(F.array(*[F.lit(k) for k in levels])).alias("level")).where(F.col("level") < F.length("start"))
    met = met.withColumn("lead", F.expr("left(start, level)"))
    asked = openings.select("opening", F.pow(F.lit(2), F.floor(F.log2(F.length("opening") + F.lit(0.5)))).cast("int").alias("level")).withColumn("lead", F.expr("left(opening, level)"))
    found = asked.join(met, ["level", "lead"]).where(F.startswith("start", "opening") & (F.length("start") > F.length("opening")))
    return found.groupBy("opening").agg(F.sum("n").alias("longer"))


def truncated(values: DataFrame, titles: DataFrame) -> DataFrame:
    """(row_id, field_name, site) of truncated values.

    values(row_id, field_name, site, value); titles(value): finished texts without a full stop. NULLs, blanks and
    stand-ins for missing values are no cases, nor are finished values without a full stop.
    """
    counts = stage(corpus_counts(values, titles), "corpus-counts")
    text, line = F.rtrim(F.col("value"), F.lit(BLANKS)), F.col("line")
    said = (F.octet_length(F.trim("value", F.lit(BLANKS))) > STAND_IN_BYTES) | says_something(F.col("value"))
    tails = values.where(said).select("row_id", "field_name", "site", F.length("value").alias("n_chars"), text.alias("text"), F.substring_index(text, "\n", -1).alias("line"))
    n_head = F.octet_length("text") - F.octet_length(line)
    entry = line
    for mark in ENTRY_MARKS:
        entry = F.substring_index(entry, mark, -1)
    tails = tails.select(
        "row_id", "field_name", "site", "n_chars", "line", F.when(n_head > 0, F.xxhash64(F.substring(F.col("text").cast("binary"), F.lit(1), n_head))).alias("head"),
        F.right(line, F.lit(END_CHARS)).alias("end"), F.right(line, F.lit(1)).alias("final"), F.trim(entry).alias("last_entry"),
    )
    end, final, last_entry = F.col("end"), F.col("final"), F.col("last_entry")
    odd = final.isin(*_LINE_ENDS)
    half_number = end.rlike(r"(?:^|[\s $€£(])[$€£]?\d[\d.,]*\.$") & ~end.rlike(r"(?:^|\s)(?:19|20)\d\d\.$") | end.rlike(r"(?:^|\s)\p{Lu}\.$")
    last_token = F.reverse(F.regexp_extract(F.reverse(end), r"^[^\p{L}\p{N}]*([\p{L}\p{N}'’-]*[\p{L}\p{N}])", 1))  # from the end, where the search starts
    tails = tails.select(
        "row_id", "field_name", "site", "n_chars", "line", "head", "last_entry",
        ((final.isin(*_MARK_ENDS) | odd | end.endswith("...")) & end.rlike(CUT_MARK)).alias("marked"),
        (final.isin(*_END_MARKS) | odd & end.rlike(END_MARK)).alias("ended"),
        ((odd | (final == ".") & F.right(end, F.lit(2)).rlike(r"^[\d.,\p{Lu}]")) & half_number).alias("half_number"),
        _casefold(last_token).alias("last"),
        _casefold(F.regexp_replace(last_entry, r"[^\p{L}]+", "")).alias("entry"),
    )
    whole_lead = F.left(F.concat(_figure(last_entry), F.col("entry")), F.lit(KNOWN_LINE_CHARS + 1))  # the letters are there already
    opening = F.when(F.length(last_entry) <= 2 * KNOWN_LINE_CHARS, whole_lead).otherwise(_lead(last_entry, 2 * KNOWN_LINE_CHARS, KNOWN_LINE_CHARS + 1))
    tails = stage(tails.withColumn("opening", F.when(F.col("entry") != "", opening)).drop("last_entry"), "tails")
    unmarked = tails.where(~F.col("marked") & ~F.col("ended"))

    # final tokens against the trie of the vocabulary
    words = counts.where((F.col("kind") == "v") & (F.col("token") != "")).select(F.col("token").alias("last"), "n")
    asked = unmarked.where((F.col("last") != "") & ~F.col("last").rlike(r"^\p{N}")).select("last").distinct().join(words, "last", "left")
    nodes = words.where(F.length("last") > 1).select(F.explode(F.sequence(F.lit(1), F.length("last") - 1)).alias("k"), F.col("last").alias("w"), F.col("n").alias("m"))
    nodes = nodes.select(F.expr("substring(w, 1, k)").alias("last"), "m").groupBy("last").agg(F.sum("m").alias("go_on"))
    rare = F.coalesce("n", F.lit(0)) * FAR_RARER < F.col("go_on")  # half words also stand where a cut was not told as one
    cut_words = asked.join(nodes, "last").where(rare).select("last", F.lit(True).alias("cut_word"))

    # a last line that stands complete elsewhere, or on which many different texts end, is finished, unless lines that
    # go on begin like it: the starts of a stock paragraph also stand at many ends, but go on far more often
    whole = counts.where((F.col("kind") == "k") & (F.col("n") >= KNOWN_LINE_TIMES)).select(F.col("token").alias("entry"), "n")
    closing = tails.where((F.col("entry") != "") & F.col("head").isNotNull() & (F.length("line") <= KNOWN_LINE_CHARS)).groupBy("entry").agg(F.countDistinct("head").alias("n"))
    whole = whole.unionByName(closing.where(F.col("n") >= KNOWN_LAST_TIMES)).groupBy("entry").agg(F.sum("n").alias("n"))
    whole = stage(whole.join(unmarked.where(F.col("entry") != "").select("entry", "opening").distinct(), "entry"), "complete-lines")
    longer = goes_on(values, whole.select("opening"))
    finished = stage(whole.join(longer, "opening", "left").where(F.coalesce("longer", F.lit(0)) <= F.col("n") * GOES_ON).select("opening", F.lit(True).alias("finished")), "finished-lines")
    # half a word at the end is a cut, however many end so
    open_ended = unmarked.join(cut_words, "last", "left").join(finished, "opening", "left").where(F.col("cut_word").isNotNull() | F.col("finished").isNull()).drop("finished")

    # how the last line reads
    spoken = counts.where(F.col("kind").isin("s", "l"))
    kind_n = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    by_token = stage(spoken.groupBy("token").agg(kind_n("s").alias("s"), kind_n("l").alias("l")), "token-counts")
    all_s, all_l, size = by_token.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0)), F.count("*")).first()
    weight = F.log((F.col("s") + SMOOTH) / F.lit(float(all_s + SMOOTH * size + 1))) - F.log((F.col("l") + SMOOTH) / F.lit(float(all_l + SMOOTH * size + 1)))
    weights = by_token.select("token", weight.alias("w"))
    lower = F.transform(F.regexp_extract_all(_casefold(line), F.lit(f"({TOKEN})"), F.lit(1)), lambda t: F.when(t.rlike(r"^\p{N}"), "0").otherwise(F.regexp_replace(t, r"['’-]+$", "")))
    known_part = F.when(F.size("t") > 1, F.slice("t", 1, F.size("t") - 1)).otherwise(F.col("t"))  # the final token may be half a word
    pairs = F.zip_with(F.concat(F.array(F.lit("^")), F.slice("t", F.lit(1), F.size("t") - 1)), F.col("t"), lambda a, b: F.concat_ws(" ", a, b))
    featured = open_ended.select("row_id", "field_name", lower.alias("t")).select("row_id", "field_name", known_part.alias("t")).where(F.size("t") > 0)
    featured = featured.select("row_id", "field_name", F.explode(F.concat(F.col("t"), pairs)).alias("token"))
    reads = featured.join(weights, "token").groupBy("row_id", "field_name").agg(F.sum("w").alias("reads"))

    # lengths at which open-ended values pile up
    lengths = open_ended.groupBy("field_name", "n_chars").agg(F.count("*").alias("n"))
    around = F.explode(F.array(*[F.lit(d) for d in range(-5, 6) if d])).alias("d")
    usual = lengths.select("field_name", "n", "n_chars", around).withColumn("n_chars", F.col("n_chars") + F.col("d")).groupBy("field_name", "n_chars").agg(F.sum("n").alias("near"))
    piles = lengths.join(usual, ["field_name", "n_chars"], "left").where((F.col("n") >= PILE_TIMES) & (F.col("n") >= F.coalesce("near", F.lit(0)) * 0.5))
    piles = piles.select("field_name", "n_chars", F.lit(PILE_BONUS).alias("pile"))

    judged = (
        open_ended.join(reads, ["row_id", "field_name"], "left").join(piles, ["field_name", "n_chars"], "left")
        .withColumn("score", F.coalesce("reads", F.lit(0.0)) + F.coalesce("pile", F.lit(0.0)))
    )
    by_evidence = judged.where(F.coalesce("cut_word", F.lit(False)) | (F.col("score") > 0))
    plain = tails.where(F.col("marked") | F.col("half_number"))
    return plain.select("row_id", "field_name", "site").unionByName(by_evidence.where(~F.col("half_number")).select("row_id", "field_name", "site"))


def share_by_site(values: DataFrame, cases: DataFrame) -> DataFrame:
    """(site, field_name, n_values, n_truncated, share) over values that say something; rows without a site under NULL."""
    alls = values.where(says_something(F.col("value"))).groupBy("site", "field_name").agg(F.count("*").alias("n_values"))
    cut = cases.groupBy(F.col("site").alias("s"), F.col("field_name").alias("f")).agg(F.count("*").alias("n"))
    joined = alls.join(cut, F.col("site").eqNullSafe(F.col("s")) & (F.col("field_name") == F.col("f")), "left")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return joined.select("site", "field_name", "n_values", n.alias("n_truncated"), F.round(n / F.col("n_values"), 4).alias("share"))
