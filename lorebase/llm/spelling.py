"""Spelling variants: words one edit apart, found with forward and backward minimal acyclic automata.

Of two words one edit apart, either the first half of one matches exactly and the rest has the error, or
its second half does. So every word is dealt, as an entry, to the halves that a word of its length or
one more or less would look under, from the front and from the back, and asks under its own two halves.
A task numbers its entries by a minimal automaton of the words and one of the reversed words (the number
of a word is the sum of the words passed by on its path), walks the exact half, and completes it
with one error. A pair met from both ends counts at the front only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpointed, sized, tasks_for

#: Entries that one half may bring to one task; a half with more is split, and its words ask in every part.
SHARD = 50_000


class Automaton:
    """Minimal acyclic automaton of sorted distinct words, with their places in the order as perfect hash."""

    def __init__(self, words: list[str]):
        edges, final, known, path, before = [{}], [False], {}, [0], ""

        def settle(depth: int) -> None:
            """States of the last word's path below ``depth`` won't change: equal ones become one."""
            while len(path) > depth + 1:
                state, c = path.pop(), before[len(path) - 1]
                form = (final[state], *edges[state].items())
                same = known.setdefault(form, state)
                if same != state:
                    edges[path[-1]][c] = same
                    edges.pop(), final.pop()

        for word in words:
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            settle(same)
            for c in word[same:]:
                edges.append({})
                final.append(False)
                edges[path[-1]][c] = len(edges) - 1
                path.append(len(edges) - 1)
            final[path[-1]] = True
            before = word
        settle(0)
        # a state's words, children first; then each edge as (next state, words passed by)
        count = [0] * len(edges)
        order, stack = [], [0]
        seen = bytearray(len(edges))
        while stack:
            state = stack.pop()
            if state < 0:
                order.append(~state)
            elif not seen[state]:
                seen[state] = 1
                stack.append(~state)
                stack.extend(edges[state].values())
        self.edges, self.final = edges, final
        for state in order:
            passed = int(final[state])
            for c, to in edges[state].items():
                edges[state][c] = (to, passed)
                passed += count[to]
            count[state] = passed

    def walk(self, state: int, number: int, text: str, at: int) -> tuple[int, int]:
        """State and number after ``text`` from ``at`` on; state -1 if no word goes on like that."""
        edges = self.edges
        for k in range(at, len(text)):
            if (step := edges[state].get(text[k])) is None:
                return -1, 0
            state, number = step[0], number + step[1]
        return state, number

    def one_error(self, text: str, exact: int) -> list[int]:
        """Numbers of the words that equal ``text`` in the first ``exact`` places and have one edit behind; each once.

        An insertion goes behind letters equal to it and a deletion takes the last of equal letters, so
        every attempt leaves the text's own path at once.
        """
        state, number = self.walk(0, 0, text[:exact], 0)
        found, edges, final, n = [], self.edges, self.final, len(text)
        if state < 0:
            return found
        for i in range(exact, n + 1):
            here = text[i] if i < n else ""
            for c, (to, passed) in edges[state].items():
                if c != here:
                    end, no = self.walk(to, number + passed, text, i)  # c inserted
                    if end >= 0 and final[end]:
                        found.append(no)
                    if here:
                        end, no = self.walk(to, number + passed, text, i + 1)  # c for here
                        if end >= 0 and final[end]:
                            found.append(no)
            if not here:
                break
            if i + 1 == n or text[i + 1] != here:  # here left out
                end, no = self.walk(state, number, text, i + 1)
                if end >= 0 and final[end]:
                    found.append(no)
            if (step := edges[state].get(here)) is None:
                break
            state, number = step[0], number + step[1]
        return found


def half(n: int) -> int:
    """The first places of a word of n that count as its first half."""
    return n // 2


def _near(it):
    """Of a task's rows (back, word, n, entry, asks): (word, near, best n, best word) for each word that asks."""
    entries, asking = ({}, {}), ([], [])
    for batch in it:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            back, word, n, entry, asks = r
            if entry:
                entries[back][word] = n
            if asks:
                asking[back].append(word)
    out = []
    for back in (0, 1):
        turned = sorted(w[::-1] for w in entries[back]) if back else sorted(entries[back])
        automaton = Automaton(turned)
        for word in sorted(set(asking[back])):
            front = word[: half(len(word))]
            if back:
                near = [w for k in automaton.one_error(word[::-1], len(word) - len(front)) if not (w := turned[k][::-1]).startswith(front)]
            else:
                near = [turned[k] for k in automaton.one_error(word, len(front))]
            if near:
                n, best = min((-entries[back][w], w) for w in near)
                out.append((word, len(near), -n, best))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["word", "near", "best_n", "best"])
        out = []


def near_words(vocabulary: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, near, best_n, best) for the words of ``vocabulary(word, n)`` (distinct words) that have a near one.

    ``near`` counts the words exactly one inserted, deleted or replaced code point away; ``best`` is that of
    largest n, of equals the first in code-point order. A half that many words share is split among
    tasks by its entries' hashes, and each of its words asks in all of them. A task holds its words as
    Python strings and some 400 bytes for each of their code points.
    """
    long, sides = F.length("word"), []
    for back in (0, 1):
        size = (lambda n: n - F.floor(n / 2)) if back else (lambda n: F.floor(n / 2))
        own = size(long)
        for other in (size(long - 1), size(long + 1)):
            sides.append((back, own, other))
    rows = F.array_distinct(F.array(*(F.struct(F.lit(b).alias("back"), x.cast("int").alias("places"), (x == own).alias("asks")) for b, own, other in sides for x in (own, other))))
    keyed = vocabulary.select("word", "n", F.explode(rows).alias("r")).select("word", "n", "r.*")
    part = F.when(F.col("back") == 0, F.expr("left(word, places)")).otherwise(F.expr("right(word, places)"))
    keyed = keyed.select("back", part.alias("half"), "word", "n", "asks")
    hot = checkpointed(keyed.groupBy("back", "half").count().where(F.col("count") > shard).select("back", "half", F.ceil(F.col("count") / shard).cast("int").alias("parts")))
    keyed = keyed.join(sized(hot, hot.count()), ["back", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    dealt = keyed.withColumn("part", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own)))).withColumn("entry", F.col("part") == own)
    n = tasks_for(vocabulary.sparkSession, 4 * vocabulary.count(), shard)
    dealt = dealt.repartition(n, "back", "half", "part").select("back", "word", "n", "entry", "asks")
    found = dealt.mapInArrow(_near, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b")).select("word", "near", (-F.col("b.minus")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms(word, form)``, a form for each word that has one: the end of each chain, by doubling steps."""
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = checkpointed(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def grouped(counts: DataFrame, ratio: int = 5, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for ``counts(word, n)``: a word's form is its best near word if that is ``ratio`` times as frequent."""
    vocabulary = checkpointed(counts.select("word", "n"))
    fits = F.col("best_n") >= ratio * F.col("n")
    joined = vocabulary.join(near_words(vocabulary, shard), "word", "left")
    words = checkpointed(joined.select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")))
    ends = roots(words.where("form is not null").select("word", "form"))
    return words.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def damaged(doc_id: Column, run: Column, every: int = 199) -> Column:
    """``run``, or, where ``every`` divides the CRC-32 of ``<doc_id>:<run>``, without one code point; a null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(documents: DataFrame, least: int = 6, often: int = 5) -> DataFrame:
    """(word, n): the damaged runs of letters of at least ``least`` code points that occur ``often`` times in all texts."""
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), 0)  # maximal: shorter runs can't give a word
    runs = documents.select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    words = runs.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def spelling(documents: DataFrame) -> DataFrame:
    """Per word of the documents: (word, form, root, n, n_near, form_n).

    Null and empty texts have no words, repeated rows count again, a null doc_id counts as empty, whole texts
    are read, columns beside doc_id and text may have any name, and an empty table gives no rows.
    """
    return grouped(counted(documents))
