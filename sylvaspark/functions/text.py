"""Column expressions on text: tokens, placeholders, names, numerals, semesters, programmes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders, one set for each place that has its own.
ANSWER_MISSING = ["", "/", "\\", "无", "-", "—", "–", "－", "暂无", "无。", "n/a", "na", "none", "null", "...", "…"]
PROFILE_MISSING = ["", "/", "-", "—", "无", "暂无", "n/a", "na", "none", "null"]
PLAN_MISSING = ["", "/", "／", "无", "-", "—", "暂无", "none", "null"]
# Punctuation that course names are compared without.
NAME_MARKS = r"[\s　·・_\-—–:：/\\（）()【】\[\]《》〈〉“”\"'、，,。.；;]+"
NUMERALS = "零一二三四五六七八九十"
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"


SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def latin_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z0-9]+)"), 1)


def cjk_bigrams(c: Column) -> Column:
    """Pairs of neighbouring Han characters after all other characters are taken out, so pairs may span a gap."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(c), "[^一-鿿]", ""), F.lit("(?=(..))"), 1)


def tokens(c: Column) -> Column:
    """Latin words of two characters or more and Han bigrams, with repetition. Null gives an empty array."""
    t = F.coalesce(c, F.lit(""))
    return F.concat(latin_tokens(t), cjk_bigrams(t))


def is_missing(c: Column, words: list[str] = ANSWER_MISSING, fold: bool = False) -> Column:
    t = strip(c)
    return c.isNull() | (F.lower(t) if fold else t).isin(words)


def clean(c: Column, words: list[str] = PLAN_MISSING) -> Column:
    """Trimmed text, '' for placeholders in any letter case."""
    return F.when(is_missing(c, words, True), F.lit("")).otherwise(strip(c))


def first_present(*columns: Column) -> Column:
    """The first value that is no placeholder."""
    return F.coalesce(*[F.when(~is_missing(c), c) for c in columns])


def name_list(c: Column) -> Column:
    """Names of a list in order, each once, without placeholders and trailing marks."""
    parts = F.transform(F.split(c, f"(?:[、,，;；/]|{SPACE})+"), lambda x: F.regexp_replace(x, "^[。；;：:]+|[。；;：:]+$", ""))
    return F.array_distinct(F.filter(parts, lambda x: ~x.isin(ANSWER_MISSING)))


def course_key(c: Column) -> Column:
    """A course name as it is compared: lower case, without a source suffix and punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"转自\s*doc", ""), NAME_MARKS, "")


def number_or_null(c: Column) -> Column:
    t = strip(c)
    return F.when(t.rlike(NUMBER), t.cast("double"))


def semester_column(c: Column) -> Column:
    """A whole number from 1 to 12, else null."""
    n = number_or_null(c)
    return F.when((n == F.floor(n)) & n.between(1, 12), n.cast("int"))


def semester_label(c: Column) -> Column:
    t, n = clean(c), semester_column(c)
    a, b = F.regexp_extract(t, r"^(\d+)\s*[-–~～至]\s*(\d+)$", 1), F.regexp_extract(t, r"^(\d+)\s*[-–~～至]\s*(\d+)$", 2)
    return F.when(n.isNotNull(), F.concat(F.lit("第 "), n.cast("string"), F.lit(" 学期"))).when(t == "", F.lit("未标注")).when(a != "", F.concat(F.lit("第 "), a, F.lit("–"), b, F.lit(" 学期（弹性）"))).otherwise(t)


def _numeral(n: Column) -> Column:
    return F.substring(F.lit(NUMERALS), n + 1, F.lit(1))


def semester_display(c: Column) -> Column:
    """A semester as year of study: odd semesters are the first half of a year."""
    n = semester_column(c)
    year = F.floor((n + 1) / 2).cast("int")
    half = F.when(n % 2 == 1, "上").otherwise("下")
    t = strip(c)
    a = F.regexp_extract(t, r"^(\d{1,4})\s*[-–~～至]\s*(\d{1,4})$", 1).try_cast("int")
    b = F.regexp_extract(t, r"^(\d{1,4})\s*[-–~～至]\s*(\d{1,4})$", 2).try_cast("int")
    ya, yb = _numeral(F.floor((a + 1) / 2).cast("int")), _numeral(F.floor((b + 1) / 2).cast("int"))
    span = F.when(ya == yb, F.concat(F.lit("大"), ya)).otherwise(F.concat(F.lit("大"), ya, F.lit("至大"), yb))
    single = F.concat(F.lit("第 "), n.cast("string"), F.lit(" 学期（大"), _numeral(year), half, F.lit("学期）"))
    ranged = F.concat(F.lit("第 "), a.cast("string"), F.lit("–"), b.cast("string"), F.lit(" 学期均可修读（"), span, F.lit("）"))
    return F.when(n.isNotNull(), single).when((a >= 1) & (a <= b) & (b <= 12), ranged).otherwise(c)


def course_group(category: Column, subcategory: Column) -> Column:
    t = F.concat_ws(" ", F.coalesce(category, F.lit("")), F.coalesce(subcategory, F.lit("")))
    rules = [("公共", "public"), ("核心", "core"), ("实践", "practice"), ("实习", "practice"), ("基础", "foundation"), ("选修", "elective"), ("辅修", "minor")]
    out = F.lit("other")
    for word, group in reversed(rules):
        out = F.when(t.contains(word), group).otherwise(out)
    return out


def chinese_number(c: Column) -> Column:
    """Numerals up to 百 as an integer; digits as they are; null for anything else."""
    digit = lambda x: F.when(x == "两", F.lit(2)).otherwise(F.instr(F.lit("一二三四五六七八九"), x))
    t = F.trim(c)
    left, right = F.regexp_extract(t, "^([一二两三四五六七八九]?)十([一二三四五六七八九]?)$", 1), F.regexp_extract(t, "^([一二两三四五六七八九]?)十([一二三四五六七八九]?)$", 2)
    tens = F.when(left == "", F.lit(1)).otherwise(digit(left)) * 10 + F.when(right == "", F.lit(0)).otherwise(digit(right))
    return F.when(t.rlike(r"^\d{1,6}$"), t.try_cast("int")).when(t.rlike("^[一二两三四五六七八九]$"), digit(t)).when(t == "百", F.lit(100)).when(t.rlike("^[一二两三四五六七八九]?十[一二三四五六七八九]?$"), tens).cast("int")


def chapter_number(title: Column) -> Column:
    return chinese_number(F.regexp_extract(title, r"第\s*([一二两三四五六七八九十百\d]+)\s*[章讲节周]", 1))


def core_program(c: Column, types: list[str]) -> Column:
    """A plan's title without its affixes: what precedes the school or year, then suffixes, longest first, as often as they occur, but never all of it."""
    t = strip(F.coalesce(c, F.lit("")))
    for prefix in ("^.*学院", "^.*学校", r"^\d{4}\s*级"):
        t = F.regexp_replace(t, prefix, "")
    words = "|".join([*sorted((x for x in types if x), key=lambda x: (-len(x), x)), "培养方案", "教学计划", "专业"])
    return F.trim(F.regexp_replace(t, f"(?<=.)(?:{words})+$", ""))


def college(c: Column) -> Column:
    found = F.regexp_extract(F.trim(c), "^(.*?学院)", 1)
    return F.when(c.isNull() | (found == ""), F.lit("未标注学院")).otherwise(found)


def text_hash(c: Column) -> Column:
    """Hash of a text without white space, in lower case."""
    return F.sha2(F.lower(F.regexp_replace(c, r"\s+", "")), 256)


def stable_id(label: Column, value: Column, size: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", label, value), 256), 1, size)


def sql_list(words: list[str]) -> str:
    """The words as an SQL list, for oracles and expressions."""
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
