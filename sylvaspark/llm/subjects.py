"""Subject areas of documents from labelling functions weighed by a latent model.

Every statement of a document gets four votes: of a lexicon learned from labelled samples, of the rest of its section, of the document's address (web host or course-code prefix) and of its source. A latent class stands behind each statement: one of the subjects, or none (remarks on how a course is run). The model learns from agreement alone, by expectation-maximisation over vote patterns, how often the lexicon names each subject rightly, wrongly or not at all, and how often section, address and source together agree with it; the three describe the same surroundings, so they are taken jointly and don't count three times. There are at most (subjects + 1) ** 4 patterns, whatever the size of the corpus. Documents are assigned from the posterior probabilities of their statements, summed over those that are more probably of some subject than of none."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaspark.common import Steps, join_lookup, spread, table

FUNCTIONS = ["lexicon", "section", "address", "source"]
#: Labelled samples that are read, the first by a hash of their id; the bound of the fitted lexicon.
SAMPLES = 20_000
PURITY = 0.9
#: An entry learned from the samples stays if this share of its places in the corpus, in documents of one clear subject, agrees.
SOUND = 0.7
#: A host, code prefix or source votes for the most frequent subject of its documents that have a clear one, if they are this many and the subject is this many times as frequent there as in all documents; what stands for no subject in particular is silent.
PLACED, PLACE_LIFT = 5, 1.5
#: The rest of a section votes if it has this many statements with a lexicon vote and this share of them agrees; what is mixed tells nothing of a single statement.
AROUND, AROUND_SHARE = 4, 0.85
#: Share of the statements from which on a second subject counts, and their least number (sums of probabilities).
SECOND_SHARE, SECOND_COUNT = 0.27, 1.5
#: Observations that a rate of the model is worth before it has seen any.
PSEUDO = 10.0

HAN = "⺀-⿟々〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
LEAD = re.compile(r"^\s*(?:第\d+周|week \d+|[-*•·|]|\d{1,2}[.、)]|[问答qa][:：])\s*", re.I)
END = re.compile(r"(?<=[。！？!?；;])|(?<=\.)\s")
HOST = re.compile(r"(?:https?://|www\.|@)([\w-]+(?:\.[\w-]+)+)", re.I)
PREFIX = re.compile(r"\s*([^\W\d_]+)")
TAG = re.compile(r"</?[a-z][^<>\r\n]*>|&[a-z]+;", re.I)
#: Format characters and combining marks.
INVISIBLE = re.compile("[­̀-ͯ؀-؅؜۝܏᠋-᠎​-‏‪-‮⁠-⁯⃐-⃰︀-️︠-︯﻿￹-￻\U000e0001-\U000e01ef]")
WORD = re.compile(rf"[{HAN}]+|[^\W\d_{HAN}][^\W\d_{HAN}'-]*")


def is_blank(text: str | None) -> bool:
    return text is None or not INVISIBLE.sub("", text).strip()


def statements(text: str) -> list[tuple[int, str]]:
    """(section, statement) of a text; sections are apart by blank lines or lines without a final mark."""
    out, section = [], 0
    if "<" in text or "&" in text:
        text = TAG.sub("", text)
    for line in INVISIBLE.sub("", text).replace("\r", "\n").split("\n"):
        bare = LEAD.sub("", line).strip()
        if not bare or bare[-1] not in "。！？!?；;.":
            section += 1
        out += [(section, s) for s in END.split(bare) if s and not s.isspace()]
    return out


def plain(statement: str) -> str:
    """Lower-case words apart by single spaces, with one at either end; Han runs are words too."""
    return f" {' '.join(WORD.findall(statement.lower()))} "


def grams(statement: str) -> set[str]:
    """Two to six neighbouring Han characters; one to three neighbouring words of other scripts, with spaces around."""
    out: set[str] = set()
    words: list[str] = []
    for w in plain(statement).split():
        if re.match(f"[{HAN}]", w):
            for n in range(2, 7):
                out.update(w[i : i + n] for i in range(len(w) - n + 1))
            words.append("")
        else:
            words.append(w)
    for n in (1, 2, 3):
        out.update(f" {' '.join(words[i : i + n])} " for i in range(len(words) - n + 1) if all(words[i : i + n]))
    return out


def pure(counts: dict[str, dict[str, int]], least: float, purity: float = PURITY) -> dict[str, str]:
    """Grams that stand almost only with one subject."""
    out = {}
    for g, c in counts.items():
        n = sum(c.values())
        s, k = max(c.items(), key=lambda x: (x[1], x[0]))
        if n >= least and k >= purity * n:
            out[g] = s
    return out


class Lexicon:
    """Entries with their places in a list, found in a statement by one pass of an automaton."""

    def __init__(self, entries: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, g in enumerate(entries):
            self.automaton.add_word(g, i)
        if entries:
            self.automaton.make_automaton()

    def found(self, statement: str) -> list[int]:
        return [i for _, i in self.automaton.iter(plain(statement))] if len(self.automaton) else []


def majority(votes: dict[int, float]) -> int:
    """The place of the largest count, -1 if there is none; ties go to the first."""
    return min(votes.items(), key=lambda x: (-x[1], x[0]))[0] if votes else -1


def agreed(votes: Counter, own: int) -> int:
    """The subject that the rest of a section agrees on, without one vote for `own`; -1 if it doesn't."""
    n = votes.total() - (own >= 0)
    if n < AROUND:
        return -1
    s = max(votes, key=lambda x: (votes[x] - (x == own), -x))
    return s if votes[s] - (s == own) >= AROUND_SHARE * n else -1


def places(text: str, code: str | None, source: str | None, kind: str | None) -> tuple[str, str]:
    """Keys of the address and of the source of a document."""
    host = HOST.search(text)
    prefix = PREFIX.match(code or "")
    return (f"host {host.group(1).lower()}" if host else f"code {prefix.group(1).upper()}" if prefix else ""), f"{source or ''}/{kind or ''}"


class Model:
    """Rates of the labelling functions and of the classes: `k` subjects and, last, no subject.

    The lexicon names a statement's own subject, is silent or names one of the others, each at a rate of that subject. The other functions are taken together: a cell says which of them agree with the subject, disagree or are silent, and which of those that disagree agree with each other; all votes of one cell are equally likely."""

    def __init__(self, patterns: np.ndarray, n: np.ndarray, k: int):
        self.votes, self.n, self.k = patterns, n, k
        total = max(n.sum(), 1.0)
        silent = n[patterns[:, 0] < 0].sum() / total if len(n) else 0.0
        self.prior = np.append(np.full(k, (1 - 0.9 * silent) / k), max(0.9 * silent, 1e-6))
        self.prior /= self.prior.sum()
        self.right, self.quiet = np.full(k, 0.87), np.append(np.full(k, 0.1), 0.97)
        context = {}
        for p, x in zip(map(tuple, patterns[:, 1:]), n):
            context[p] = context.get(p, 0.0) + x
        self.anywhere = np.array([context[tuple(p)] / total for p in patterns[:, 1:]]) if len(n) else np.zeros(0)
        self.cells: dict[tuple, int] = {}
        self.cell = np.array([[self._cell(p, s) for s in range(k)] for p in patterns[:, 1:].tolist()], dtype=int).reshape(len(n), k)
        self.ways = np.array([self._ways(c) for c in self.cells])
        self.joint = np.array([np.prod([(0.25, 0.6, 0.15)[m] if j == 0 else (0.3, 0.35, 0.35)[m] for j, m in enumerate(c[0])]) for c in self.cells])
        self.joint = self.joint / max(self.joint.sum(), 1e-12)
        self.rounds = 0

    def _cell(self, votes: list[int], s: int) -> int:
        marks = tuple(0 if v < 0 else 1 if v == s else 2 for v in votes)
        others = [v for v in votes if v >= 0 and v != s]
        groups = tuple(others.index(v) for v in others)
        return self.cells.setdefault((marks, groups), len(self.cells))

    def _ways(self, cell: tuple) -> float:
        """How many different votes fall into a cell."""
        w = 1.0
        for i in range(len(set(cell[1]))):
            w *= max(self.k - 1 - i, 1)
        return w

    def posterior(self) -> np.ndarray:
        """Probability of each class, the last for no subject, for each pattern."""
        k, v = self.k, self.votes[:, 0]
        lex = np.empty((len(v), k + 1))
        wrong = np.maximum(1 - self.right - self.quiet[:k], 1e-9) / max(k - 1, 1)
        lex[:, :k] = np.where(v[:, None] < 0, self.quiet[:k], np.where(v[:, None] == np.arange(k), self.right, wrong))
        lex[:, k] = np.where(v < 0, self.quiet[k], (1 - self.quiet[k]) / k)
        context = np.column_stack([self.joint[self.cell] / self.ways[self.cell], self.anywhere]) if len(v) else np.zeros((0, k + 1))
        p = self.prior * lex * context
        return p / np.maximum(p.sum(1, keepdims=True), 1e-300)

    def learn(self, rounds: int = 300, moved: float = 1e-4) -> None:
        """Expectation-maximisation until no rate moves by more than `moved`; `rounds` tells how many it took."""
        k, v = self.k, self.votes[:, 0]
        for self.rounds in range(1, rounds + 1 if len(v) and k > 1 else 1):
            w = self.posterior() * self.n[:, None]
            mass = w.sum(0)
            own = np.array([w[v == s, s].sum() for s in range(k)])
            quiet = w[v < 0].sum(0)
            cells = np.bincount(self.cell.ravel(), w[:, :k].ravel(), minlength=len(self.cells))
            new = ((mass + 1) / (mass + 1).sum(), (own + 0.87 * PSEUDO) / (mass[:k] + PSEUDO), np.append((quiet[:k] + 0.1 * PSEUDO) / (mass[:k] + PSEUDO), self.quiet[k]), (cells + PSEUDO * self.joint) / (cells.sum() + PSEUDO))
            change = max(np.abs(a - b).max() for a, b in zip(new, (self.prior, self.right, self.quiet, self.joint)))
            self.prior, self.right, self.quiet, self.joint = new
            if change < moved:
                break

    def accuracies(self) -> dict[str, float]:
        """How often each function is right where it votes."""
        out = {"lexicon": float((self.prior[: self.k] * self.right).sum() / max((self.prior[: self.k] * (1 - self.quiet[: self.k])).sum(), 1e-12))}
        for j, name in enumerate(FUNCTIONS[1:]):
            yes = sum(x for c, x in zip(self.cells, self.joint) if c[0][j] == 1)
            no = sum(x for c, x in zip(self.cells, self.joint) if c[0][j] == 2)
            out[name] = float(yes / max(yes + no, 1e-12))
        return out


def sample_lexicon(samples: DataFrame, subject: str = "subject", text: str = "text", key: str = "sample_id", bound: int = SAMPLES) -> dict[str, str]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in samples.where(f"{subject} is not null and {text} is not null").orderBy(F.xxhash64(key), key).limit(bound).select(subject, text).collect():
        for _, s in statements(r[1]):
            for g in grams(s):
                counts[g][r[0]] += 1
    return pure(counts, 2)


def assign(docs: DataFrame, samples: DataFrame, areas: DataFrame, em: bool = True) -> tuple[DataFrame, dict[str, float]]:
    """(doc_id, subject, share) of the one or two subjects of each text, and how often each function is right where it votes.

    Null and blank texts have none. A text without any statement that the lexicon knows gets the subject that address and source make most probable. Ties go to the first subject by name; repeated rows give one result; other columns are not read; an empty table gives no rows. `em=False` leaves the model's rates at their first values, to compare."""
    spark = docs.sparkSession
    steps = Steps(spark)
    subjects = sorted(r[0] for r in areas.where("subject is not null").select("subject").distinct().collect())
    place = {s: i for i, s in enumerate(subjects)}
    learned = {g: place[s] for g, s in sample_lexicon(samples).items() if s in place}
    entries = sorted(learned)
    of = np.array([learned[g] for g in entries], dtype=int)
    size = np.array([len(g.strip()) for g in entries], dtype=float)
    d = spread(docs.select("doc_id", "text", "course_code", "source", "doc_kind").where("doc_id is not null and text is not null"))

    def vote(found: list[int], sound: np.ndarray) -> int:
        """The subject of most matched characters."""
        got: dict[int, float] = defaultdict(float)
        for i in found:
            if sound[i]:
                got[of[i]] += size[i]
        return majority(got)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, every = Lexicon(entries), np.ones(len(entries), dtype=bool)
        for b in batches:
            rows = []
            for doc, text, code, source, kind in zip(b["doc_id"], b["text"], b["course_code"], b["source"], b["doc_kind"]):
                if is_blank(text):
                    continue
                parts = statements(text)
                found = [lexicon.found(s) for _, s in parts]
                votes = [vote(f, every) if f else -1 for f in found]
                told = Counter(v for v in votes if v >= 0)
                top = majority(told)
                clear = top if top >= 0 and told[top] >= 0.8 * told.total() else None
                rows.append((doc, [n for n, _ in parts], votes, [j for j, f in enumerate(found) for _ in f], [i for f in found for i in f], clear, *places(text, code, source, kind)))
            yield pd.DataFrame(rows, columns=["doc_id", "section", "vote", "at", "entry", "clear", "address", "origin"]).astype({"clear": "Int32"})

    longs = T.ArrayType(T.IntegerType())
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, longs) for c in ("section", "vote", "at", "entry")], T.StructField("clear", T.IntegerType()), T.StructField("address", T.StringType()), T.StructField("origin", T.StringType())])
    if not subjects:
        return spark.createDataFrame([], T.StructType([docs.schema["doc_id"], T.StructField("subject", T.StringType()), T.StructField("share", T.DoubleType())])), {}
    seen = steps.write(d.mapInPandas(read, schema))  # one reading of the texts; all else works on places of entries
    # Entries of the lexicon that stand with other subjects in the corpus are chance finds in the samples. One count per entry and subject.
    sound = np.ones(len(entries), dtype=bool)
    held: dict[int, Counter] = defaultdict(Counter)
    for r in seen.where("clear is not null").select("clear", F.explode("entry").alias("entry")).groupBy("entry", "clear").count().collect():
        held[r["entry"]][r["clear"]] = r["count"]
    for i, c in held.items():
        top = max(c, key=lambda s: (c[s], s))
        sound[i] = c.total() < 5 or top == of[i] and c[top] >= SOUND * c.total()
    keys = seen.where("clear is not null").select("clear", F.explode(F.array("address", "origin")).alias("key")).where("key <> ''").groupBy("key", "clear").count()
    base = seen.where("clear is not null").groupBy(F.col("clear").alias("vote")).count().select("vote", (F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0)))).alias("usual"))  # one row a subject
    rated = keys.groupBy("key").agg(F.sum("count").alias("n"), F.max_by("clear", F.struct("count", "clear")).alias("vote"), F.max("count").alias("k")).where(F.col("n") >= PLACED)
    rated = rated.join(F.broadcast(base), "vote").where(F.col("k") >= PLACE_LIFT * F.col("usual") * F.col("n")).select("key", "vote")
    rated = steps.write(rated)
    where = join_lookup(seen.drop("clear"), rated.select(F.col("key").alias("address"), F.col("vote").alias("by_address")), "address", "left")
    where = join_lookup(steps.write(where), rated.select(F.col("key").alias("origin"), F.col("vote").alias("by_origin")), "origin", "left")

    def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, section, votes, at, entry, address, origin in zip(b["doc_id"], b["section"], b["vote"], b["at"], b["entry"], b["by_address"].fillna(-1).astype(int), b["by_origin"].fillna(-1).astype(int)):
                if not sound[entry].all():
                    found: dict[int, list[int]] = defaultdict(list)
                    for j, i in zip(at.tolist(), entry.tolist()):
                        found[j].append(i)
                    votes = np.array([vote(found[j], sound) for j in range(len(section))])
                same = Counter(zip(section.tolist(), votes.tolist()))
                around: dict[int, Counter] = defaultdict(Counter)
                for (n, v), c in same.items():
                    if v >= 0:
                        around[n][v] = c
                counts: Counter = Counter()
                for (n, v), c in same.items():
                    counts[f"{v} {agreed(around[n], v)} {address} {origin}"] += c
                if not counts:
                    counts[f"-1 -1 {address} {origin}"] = 1
                rows.append((doc, list(counts), list(counts.values())))
            yield pd.DataFrame(rows, columns=["doc_id", "patterns", "counts"])

    voted = steps.write(where.mapInPandas(patterns, T.StructType([docs.schema["doc_id"], T.StructField("patterns", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType()))])))
    # Every document weighs the same, so that a very long one doesn't teach its own subject to all.
    weighed = voted.select(F.explode(F.arrays_zip("patterns", "counts")).alias("x"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c).alias("total"))
    pairs = sorted((r["p"], r["n"]) for r in weighed.groupBy(F.col("x.patterns").alias("p")).agg(F.sum(F.col("x.counts") / F.col("total")).alias("n")).collect())  # (subjects + 1) ** 4 at most
    model = Model(np.array([[int(v) for v in p.split()] for p, _ in pairs], dtype=int).reshape(len(pairs), 4), np.array([n for _, n in pairs], dtype=float), len(subjects))
    if em:
        model.learn()
    post = model.posterior()
    known = spark.sparkContext.broadcast({p: (post[i, :-1], post[i].argmax() < len(subjects)) for i, (p, _) in enumerate(pairs)})

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, ps, ns in zip(b["doc_id"], b["patterns"], b["counts"]):
                every = [(*known.value[p], n) for p, n in zip(ps, ns)]
                told = [(x, n) for x, some, n in every if some] or [(x, n) for x, _, n in every]  # what is most probably no subject's counts only where there is nothing else
                mass = sum(x * n for x, n in told)
                share = mass / mass.sum()
                order = sorted(range(len(subjects)), key=lambda i: (-round(share[i], 9), i))
                rows.append((doc, subjects[order[0]], float(share[order[0]])))
                if len(order) > 1 and share[order[1]] >= SECOND_SHARE and mass[order[1]] >= SECOND_COUNT:
                    rows.append((doc, subjects[order[1]], float(share[order[1]])))
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "share"])

    out = voted.mapInPandas(decide, T.StructType([docs.schema["doc_id"], T.StructField("subject", T.StringType()), T.StructField("share", T.DoubleType())]))
    return out.dropDuplicates(["doc_id", "subject"]), model.accuracies()


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, float]]:
    return assign(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_samples"), table(spark, sf_dir, "subject_areas"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one or two subjects of every document."""
    return _assigned(spark, sf_dir)[0].select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their summed shares by subject."""
    return _assigned(spark, sf_dir)[0].groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.sum("share"), 3).alias("weight"))


QUERIES = {"p9_found": p9_found, "p9_composition": p9_composition}
SQL: dict[str, str] = {}
