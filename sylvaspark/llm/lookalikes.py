"""Text that looks alike brought to one plain form.

Look-alike classes come from union-find over strings and code points: every code point of the corpus with its compatibility decomposition, and the fixed groups below. The member that stands for a class is the most frequent one of the script in question, counted over all values. Whole names form classes too, those with the same class sequence; there the most frequent plain spelling stands for all. Rewriting is greedy, leftmost longest, by an Aho-Corasick automaton."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaspark.common import Steps, join_lookup, table

# Groups of letters and digits that look alike (Latin, Cyrillic, Greek, Armenian, Cherokee and others).
LETTERS = """AАΑᎪ BВΒᏴ CСϹᏟⅭ DᎠⅮ EЕΕᎬ FϜ GԌᏀ HНΗᎻ IІΙӀᏆ JЈᎫ KКΚᏦ LᏞⅬ MМΜᎷⅯ NΝ OОΟՕ PРΡᏢ QԚ SЅՏᏚ TТΤᎢ UՍ VѴᏙⅤ WԜᎳ XХΧⅩ YҮΥ ZΖᏃ
aаα cсϲⅽ dԁⅾ eеҽ gɡց hһհ iіιⅰ jјϳ kκк lⅼӏӀ mⅿ nոη oоοօ pрρ qԛգ rг sѕ uսυ vνѵⅴ wԝա xхχⅹ yуγ zᴢ æӕ"""
DIGITS = "0OОΟՕoоοօ 1lIІⅠӀ|ⅼ 2Ⅱ 3ЗӠƷз 4Ч 5Ƽ 6бϬ 8Ȣ 9Գ"
# Han characters that kana or symbols look like.
HAN = "一ー―㇐ 二ニ 三Ξ 八ハ 口ロ 工エ 力カ 夕タ 卜ト 千チ 〇○◯"
# Radicals without a decomposition of their own, each with its ordinary character.
RADICALS = "⺁厂 ⺄乙 ⺅亻 ⺈刀 ⺉刂 ⺌小 ⺍小 ⺒巳 ⺓幺 ⺔彑 ⺖忄 ⺗心 ⺘扌 ⺙攵 ⺛旡 ⺝月 ⺠民 ⺡氵 ⺢水 ⺣灬 ⺤爫 ⺦丬 ⺧牛 ⺨犭 ⺩王 ⺫目 ⺬示 ⺭礻 ⺮竹 ⺯糸 ⺰纟 ⺳网 ⺶羊 ⺷羊 ⺸羊 ⺹老 ⺻聿 ⺼肉 ⺽臼 ⺾艹 ⻀艹 ⻂衤 ⻃覀 ⻄西 ⻅见 ⻆角 ⻈讠 ⻉贝 ⻋车 ⻌辶 ⻍辶 ⻏邑 ⻐钅 ⻑長 ⻒镸 ⻓长 ⻔门 ⻖阝 ⻗雨 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻟飠 ⻠饣 ⻢马 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻪黾 ⻫斉 ⻬齐 ⻭歯 ⻮齿 ⻯竜 ⻰龙 ⻱龜 ⻲亀"
SEPARATORS = "、,;/，；／"

INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}\p{Default_Ignorable_Code_Point}--\s]", regex.V1)
SPACE = regex.compile(r"[\p{White_Space}\p{Z}]")
DASH = regex.compile(r"[\p{Pd}−⁃˗➖--〜〰゠]", regex.V1)
SCRIPT = [(n, regex.compile(rf"\p{{Script={n}}}")) for n in ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Han", "Hangul", "Hiragana", "Katakana")]


@lru_cache(None)
def script(c: str) -> str:
    """Script of a letter; '' for digits, marks and signs. The long-vowel mark counts as Katakana."""
    if c in "ー":
        return "Katakana"
    if not c.isalpha() and not regex.match(r"\p{Nl}", c):
        return ""
    return next((n for n, p in SCRIPT if p.match(c)), "other")


class Model:
    """Classes and rewriting tables for one inventory of code points. `counts`: code point -> occurrences in the corpus. `numeric`: the classes of values made of numbers, where letters stand for the digits that they look like, instead of the classes of letters."""

    def __init__(self, counts: dict[str, int], numeric: bool = False):
        self.counts = counts
        self.up: dict[str, str] = {}
        groups = [*(DIGITS if numeric else LETTERS).split(), *HAN.split()]
        listed = set("".join(groups))
        self.listed = listed
        for g in groups:
            for c in g[1:]:
                self.join(g[0], c)
        for pair in RADICALS.split():
            self.join(pair[0], pair[1])
        for c in counts:
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and c not in listed and not INVISIBLE.match(c) and not SPACE.match(c) and not SPACE.match(plain[:1]):
                self.join(c, plain)
        self.members: dict[str, list[str]] = defaultdict(list)
        for c in {*self.up, *counts}:
            self.members[self.find(c)].append(c)
        radicals = dict(p for p in RADICALS.split())
        self.neutral = {}
        for c in counts:
            if INVISIBLE.match(c):
                self.neutral[c] = ""
            elif SPACE.match(c):
                self.neutral[c] = " "
            elif DASH.match(c):
                self.neutral[c] = "-"
            elif c in radicals:
                self.neutral[c] = radicals[c]
            elif c not in listed and (n := unicodedata.normalize("NFKC", c)) != c:
                self.neutral[c] = DASH.sub("-", SPACE.sub(" ", n))
        self.automata: dict[str, object] = {}

    def find(self, x: str) -> str:
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a

    def best(self, c: str, target: str) -> str | None:
        """The most frequent single letter of the script (or ASCII digit) in c's class; ties go to the smallest code point."""
        ranked = sorted((-self.counts.get(m, 0), m) for m in self.members.get(self.find(c), ()) if len(m) == 1 and ("0" <= m <= "9" if target == "digit" else script(m) == target) and unicodedata.normalize("NFKC", m) == m)
        return ranked[0][1] if ranked else None

    def rewrite(self, text: str, name: str) -> str:
        """Greedy leftmost-longest replacement of every pattern of the named table."""
        if name not in self.automata:
            import ahocorasick

            if name == "neutral":
                pairs = self.neutral
            elif name == "digit":
                pairs = {c: b for c in self.listed if script(c) not in ("", "Han", "Katakana") and (b := self.best(c, "digit"))}
            elif name == "numeral":
                pairs = {c: b for c in self.listed if (script(c) == "Katakana" or c in "○◯") and (b := self.best(c, "Han"))}
            else:
                letters = {c for c in {*self.listed, *(d for c in self.counts for d in unicodedata.normalize("NFD", c))} if script(c) not in ("", name)}
                pairs = {c: b for c in letters if (b := self.best(c, name))}
            a = ahocorasick.Automaton()
            for k, v in pairs.items():
                a.add_word(k, (len(k), v))
            if len(a):
                a.make_automaton()
            self.automata[name] = a
        a = self.automata[name]
        if not len(a):
            return text
        out, at = [], 0
        for end, (n, v) in a.iter_long(text):
            out += text[at : end + 1 - n], v
            at = end + 1
        return "".join(out) + text[at:]

    def target(self, name: str) -> str:
        """The script a name is written in: of the letters that look like no letter of another script, else of all; ties by corpus frequency of the letters."""
        sure: dict[str, int] = defaultdict(int)
        every: dict[str, int] = defaultdict(int)
        for c in unicodedata.normalize("NFD", name):
            if s := script(c):
                every[s] += 1
                if len({script(m) for m in self.members.get(self.find(c), (c,))} - {""}) <= 1:
                    sure[s] += 1
        return max(sure or every or {"": 0}, key=lambda s: ((sure or every)[s], every[s], s == "Latin"), default="")

    def tidy(self, text: str) -> str:
        return regex.sub(" +", " ", unicodedata.normalize("NFC", self.rewrite(text, "neutral"))).strip(" ")

    def name(self, text: str) -> str:
        """Plain form of one name by its code points alone."""
        t = self.tidy(text)
        kana = [c for c in t if script(c) in ("Katakana", "Hiragana")]
        goal = "Han" if kana and any(script(c) == "Han" for c in t) and all(self.best(c, "Han") for c in kana) else self.target(t)
        if not goal or goal in ("Hangul", "Katakana", "Hiragana", "other"):
            return t
        base = unicodedata.normalize("NFD", t) if goal != "Han" else t
        return unicodedata.normalize("NFC", self.rewrite(base, goal))

    def number(self, text: str) -> str:
        """Plain form of a value made of numbers: look-alikes of digits become the digit of their class, those of Chinese numerals the numeral. A value with a letter that looks like no digit keeps its letters."""
        t = self.tidy(text)
        t = regex.sub(r"(?<=\p{Han})-(?=\p{Han})", "一", t)
        digits = self.rewrite(t, "digit")
        if all(script(c) in ("", "Han", "Katakana") for c in digits):
            t = digits
        if any(script(c) == "Han" for c in t) or len(t) == 1:
            t = self.rewrite(t, "numeral")
        return t

    def skeleton(self, text: str) -> str:
        """Class sequence of a plain text: equal for all texts that look alike."""
        return "".join(self.find(c) for c in unicodedata.normalize("NFD", text))

    def pure(self, text: str) -> bool:
        return len({script(c) for c in text} - {"", "Hiragana", "Katakana"}) <= 1


def inventory(dictionary: DataFrame, value: str, count: str) -> dict[str, int]:
    """Occurrences of every code point: as many rows as Unicode has characters in use, at most."""
    points = dictionary.select(F.explode(F.split(value, "")).alias("c"), F.col(count).alias("n")).where("c <> ''")
    return {r["c"]: r["n"] for r in points.groupBy("c").agg(F.sum("n").alias("n")).collect()}


def plain_forms(spark: SparkSession, values: DataFrame, numeric: list[str], spelled: int = 20) -> DataFrame:
    """(field_name, value, n) with unique (field_name, value) -> the same with `plain`.

    Fields in `numeric` hold numbers, all others names, several of them apart by one of SEPARATORS. A name takes the spelling that is most frequent in its class of look-alike names, if that is `spelled` times as frequent as its own, or its own mixes scripts. Null values have no row, blank ones the plain form ''. Very long values are one text like any other."""
    steps = Steps(spark)
    counts = inventory(values, "value", "n")
    model, numerals = Model(counts), Model(counts, numeric=True)
    cut = f"[^{SEPARATORS}]+|[{SEPARATORS}]"
    numbers, names = values.where(F.col("field_name").isin(numeric)), values.where(~F.col("field_name").isin(numeric))

    def of_numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["plain"] = [numerals.number(v) for v in b["value"]]
            yield b

    def of_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["base"] = [model.name(v) for v in b["piece"]]
            b["skeleton"] = [model.skeleton(v) for v in b["base"]]
            b["pure"] = [model.pure(v) for v in b["base"]]
            yield b

    done = numbers.mapInPandas(of_numbers, "field_name string, value string, n long, plain string")
    parts = names.select("field_name", "value", "n", F.posexplode(F.expr(f"regexp_extract_all(value, '{cut}', 0)")).alias("pos", "piece"))
    pieces = parts.groupBy("piece").agg(F.sum("n").alias("n")).mapInPandas(of_names, "piece string, n long, base string, skeleton string, pure boolean")
    pieces = steps.write(pieces)
    spellings = pieces.groupBy("skeleton", "base", "pure").agg(F.sum("n").alias("n"))
    best = spellings.where("pure").groupBy("skeleton").agg(F.max_by(F.struct("base", "n"), F.struct("n", F.hash("base"), "base")).alias("best"))
    own = spellings.groupBy("base").agg(F.sum("n").alias("own"))
    known = pieces.join(best, "skeleton", "left").join(own, "base").select("piece", F.when(F.col("best.base").isNotNull() & (~F.col("pure") | (F.col("best.n") >= spelled * F.col("own"))), F.col("best.base")).otherwise(F.col("base")).alias("to"))
    spelled_out = join_lookup(steps.write(parts), steps.write(known), "piece", "inner")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "to"))), lambda x: x["to"]), "")
    back = spelled_out.groupBy("field_name", "value").agg(F.first("n").alias("n"), text.alias("plain"))
    seps = F.translate("plain", "，；／", ",;/")
    back = back.select("field_name", "value", "n", F.trim(F.regexp_replace(seps, " +", " ")).alias("plain"))
    blank = names.where("value = ''").withColumn("plain", F.lit(""))
    return steps.write(done.unionByName(back).unionByName(blank))


def look_alikes(spark: SparkSession, df: DataFrame, key: str, fields: list[str], numeric: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (key, field_name, value) of all non-null values, repeated rows once, and their dictionary with plain forms."""
    steps = Steps(spark)
    rows = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(key, "x.*").where(f"{key} is not null and value is not null").distinct()
    rows = steps.write(rows)
    return rows, plain_forms(spark, rows.groupBy("field_name", "value").agg(F.count("*").alias("n")), numeric)


def _offerings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return look_alikes(spark, table(spark, sf_dir, "course_offerings"), "offering_id", ["instructor", "semester"], ["semester"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """offering_id and field_name of every value that differs from its plain form."""
    rows, forms = _offerings(spark, sf_dir)
    both = lambda d: d.withColumn("k", F.concat("field_name", F.lit("\x01"), "value"))
    changed = both(forms.where("plain <> value")).select("k")
    return join_lookup(both(rows), changed, "k", "inner").select("offering_id", "field_name").distinct()


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct value with its plain form and number of rows."""
    return _offerings(spark, sf_dir)[1].select("field_name", "value", "plain", "n")


QUERIES = {"p1_found": p1_found, "p1_values": p1_values}
SQL: dict[str, str] = {}
