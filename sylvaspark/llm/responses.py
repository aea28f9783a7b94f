"""Prompt-response pairs whose response is defective.

Rules run in a fixed order over every pair: no statement at all; a bare repetition of the prompt; a refusal; another language than the prompt's; a text that stops early. All rules that hold are reported, with the first of them as the pair's main defect. Whether a text without a final mark is complete is told from the corpus: how often the characters it ends with are followed by a final mark, over all answers."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaspark.common import Steps, first_by, join_lookup, table

ORDER = ["empty", "copy", "refusal", "other_language", "truncated"]

# What stands for no answer, and labels that announce one.
NOTHING = {"n/a", "na", "null", "none", "nil", "nan", "undefined", "tbd", "todo", "nbsp", "空", "暂无", "待定", "略", "答", "答案", "回答", "回复", "answer", "a", "response", "reply", "output", "assistant"}
TAGS = regex.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>|&(?:#\d+|#x[\da-f]+|[a-z]+);|```\w*", regex.S | regex.I)
# Openings that repeat a prompt before answering it.
ECHO = regex.compile(r"^(?:您?的?(?:问题|提问)(?:是|为)?|问题?|q|question|your question(?: is| was)?|you asked|用户问?|query|prompt)\W*", regex.I)
GREETING = regex.compile(r"^(?:您好|你好|老师好|同学问|请问|hi|hello|quick question|dear \w+)\W+", regex.I)

# Phrases of declining, Chinese and English and other languages.
REFUSAL = regex.compile(
    r"(?:无法|没法|不能|不便|难以|未能|不予|不作|不做|拒绝|没办法)(?:直接|具体|准确|为您|向您|给您|对此|就此)*(?:回答|作答|答复|回复|解答|作出回答|回应|评论|透露|告知|告诉|协助|代答|给出(?:答案|结论|答复))"
    r"|(?:我|本助手|本系统|助手)[^。！？!?，,]{0,8}(?:无法|没法|不能|不便|不可以|帮不了|不了解|不知道|不清楚)[^。！？!?，,]{0,4}(?:提供|帮|协助|处理|讨论|说明|满足|您|你|确认)"
    r"|(?:我|这边)[^。！？!?]{0,6}不便|恕(?:我)?(?:不能|无法|难|不)|帮不(?:了|上)(?:您|你|忙)|无可奉告"
    r"|超出(?:了)?[^。！？!?]{0,6}(?:能力|权限|知识|服务|职责|回答)[^。！？!?]{0,4}范围|不在[^。！？!?]{0,8}(?:服务|回答|知识|能力)[^。！？!?]{0,4}范围"
    r"|(?:没有|未|没)(?:能)?(?:找到|检索到|查到|查询到|搜索到|收录)[^。！？!?]{0,14}(?:信息|记录|资料|内容|材料|答案|结果|依据)"
    r"|(?:不足以|没有能|无法|不能)[^。！？!?]{0,6}(?:给出|支撑|支持|得出|形成)[^。！？!?]{0,6}(?:结论|答案|回答)|(?:证据|信息|资料|材料)不足[^。！？!?]{0,6}(?:回答|作答|判断)"
    r"|\b(?:i|we)(?:['’]m| am|['’]re| are)?\s+(?:\w+\s+){0,3}?(?:can(?:no|['’])t|can not|unable to|not able to|not allowed to|not permitted to|not in a position to|won['’]t|will not|couldn['’]t|could not|must decline|have to decline|decline to|do(?:n['’]t| not) (?:have|know|feel|hold)|have no|found no(?:thing)?|find no(?:thing)?)\b"
    r"|beyond (?:what|my|our|the scope)[^.]{0,40}(?:i['’]m|i am|we|ability|knowledge|remit|scope|allowed|able)?|outside (?:my|our|the) (?:scope|remit|knowledge|competence)"
    r"|\bno answer can be|cannot be answered|can(?:no|['’])t be answered|not (?:be )?(?:able|possible) to answer|(?:nothing|no (?:information|record|material|evidence|document|entry)s?)[^.]{0,40}(?:was found|were found|found|available|support|answer|match|on this|on that|about)|(?:do|does)(?:n['’]t| not) (?:contain|hold|include|cover|support|say)[^.]{0,30}(?:answer|information|enough|conclusion|anything)"
    r"|\bas an? (?:ai|language model|(?:course |question )?(?:assistant|bot))\b[^.]{0,40}(?:can(?:no|['’])t|unable|not)|(?:sorry|afraid|regret)[^.]{0,30}(?:can(?:no|['’])t|unable|not able|no answer|could not|couldn['’]t|no information|outside|beyond)"
    r"|je ne peux pas|ich kann (?:ihnen |das |diese )?[^.]{0,20}nicht|no puedo|не могу|не можем|お答えできません|回答できません|답변할 수 없",
    regex.I,
)
# Asking for a language.
ASKS = [
    ("en", regex.compile(r"英文|英语|in english|english (?:please|answer)|auf englisch", regex.I)),
    ("zh", regex.compile(r"(?:用|以|成)(?:简体)?(?:中文|汉语)|in chinese|(?:reply|answer|respond)[^.?!]{0,20}chinese", regex.I)),
    ("ja", regex.compile(r"日文|日语|in japanese", regex.I)), ("ru", regex.compile(r"俄文|俄语|in russian", regex.I)),
    ("fr", regex.compile(r"法文|法语|in french", regex.I)), ("de", regex.compile(r"德文|德语|in german", regex.I)), ("es", regex.compile(r"西班牙(?:文|语)|in spanish", regex.I)),
]
TRANSLATE = regex.compile(r"翻译|译成|译为|translat|怎么说|how do you say|英文名|english (?:name|title)", regex.I)
# Frequent words that tell Latin-script languages apart.
WORDS = {
    "en": "the of and to in is are it for with that this on by be as at from or yes no not you can have has will which students course examination semester credits a an each what how its who may takes written homework".split(),
    "fr": "le la les des et est une un du pour dans sur par avec qui au aux ce cette cours se sont il elle ne pas de en plus son ses être".split(),
    "de": "der die das und ist ein eine mit von zu im den dem des nicht auf für wird werden sich auch als am zum zur es sind einer drei er".split(),
    "es": "el los las y es una un del para con por que se en al son su más como no lo está curso".split(),
}
WORDS = {k: frozenset(v) for k, v in WORDS.items()}
HAN_RUN, LATIN_RUN, TWO_HAN = regex.compile(r"\p{Han}+"), regex.compile(r"\p{Latin}+"), regex.compile(r"\p{Han}{2,}")
SCRIPTS = {"kana": regex.compile(r"[\p{Hiragana}\p{Katakana}]"), "hangul": regex.compile(r"\p{Hangul}"), "cyr": regex.compile(r"\p{Cyrillic}"), "arab": regex.compile(r"\p{Arabic}"), "latin": regex.compile(r"\p{Latin}")}
RARE = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Hangul}\p{Cyrillic}\p{Arabic}]")
# Words by which a prompt shows its language.
ENGLISH = regex.compile(r"\b(?:what|which|how|when|where|who|why|can|could|is|are|does|do|please|list|summari[sz]e|tell|explain|give|describe|taught|in|of|the|for|what's)\b", regex.I)
ASKING = regex.compile(r"[吗呢么？的是什哪谁几多]")
NAMED = regex.compile(r"《[^》]*》|“[^”]*”|「[^」]*」|『[^』]*』|\"[^\"]*\"|‘[^’]*’")
TITLE = regex.compile(r"(?:\p{Lu}[\p{L}\-’']*(?:\s+(?:and|of|the|in|for|to)(?=\s+\p{Lu}))?[\s:,&–-]*){2,}")

# Words after which a sentence can't end.
DANGLING_EN = set("a an the of and or but with into than between is are was were be been has had would could may might must should its their your our his these those every because while where until per via".split())
DANGLING_ZH = regex.compile(r"(?:以及|或者|因为|所以|如果|虽然|但是|并且|而且|通过|根据|按照|关于)$")
PAIRS = {"《": "》", "（": "）", "(": ")", "【": "】", "[": "]", "“": "”", "「": "」", "『": "』", "{": "}"}
FINAL = "。！？!?."
ELLIPSIS = regex.compile(r"(?:…|\.{2,}|。{2,})+$")
TRAIL = "”’」』》）)]】\"'*`_ \t\r\n　"
# How a number of points is announced.
COUNT_WORDS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
ANNOUNCED = regex.compile(r"([一二两三四五六七八九十]|\d{1,2})\s*(?:个|条|点|项|步|类|种|部分|方面)(?:方面|部分|要点|内容|步骤|原因|建议)?[^。！？\n:：；;]{0,10}[:：]|\b(one|two|three|four|five|six|seven|eight|nine|ten|\d{1,2})\s+(?:\w+\s+)?(?:points?|things?|steps?|items?|parts?|reasons?|ways?|aspects?|stages?|topics?)\b[^.\n:]{0,20}[:：]", regex.I)
ITEM = regex.compile(r"(?:^|(?<=[\s。；;.:：，,]))[（(]?(\d{1,2}|[一二三四五六七八九十])(?:[.、)）]|[:：])(?!\d)")
BULLET = regex.compile(r"(?m)^\s*[-*•·]\s*\S")


NO_LETTER = regex.compile(r"[^\p{L}\p{N}]+")


def bare(text: str) -> str:
    """Letters and digits only, folded."""
    return NO_LETTER.sub("", unicodedata.normalize("NFKC", text)).casefold()


TAGGED = regex.compile(r"[<&`]")


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if not TAGGED.search(answer) and sum(map(str.isalnum, answer[:100])) > 20:
        return False  # more letters than any of NOTHING has
    t = TAGS.sub(" ", answer)
    core = regex.sub(r"[\s\p{Cf}\p{Cc}]+", " ", unicodedata.normalize("NFKC", t)).strip().strip(":：\"'`*_#.。-—~=…{}[]()<>/|\\!?！？,，、 ").casefold()
    return core in NOTHING or not regex.search(r"[\p{L}\p{N}]", core)


#: Share of a prompt that a copy cut short still covers.
COPIED = 0.6


def is_copy(query: str | None, answer: str) -> bool:
    """The answer is nothing but a copied prefix: after a label or greeting it repeats the prompt, whole, once or again and again, up to any cut in the last repetition; or it is the prompt itself cut short, with COPIED of it left. What follows a repetition and states nothing (a label, a placeholder) doesn't make it an answer."""
    q = bare(query or "")
    a = answer.strip()
    if len(q) < 4:
        return False
    forms = {q, bare(GREETING.sub("", (query or "").strip()))} - {""}
    shortest = min(map(len, forms))
    for t in {a, ECHO.sub("", a), GREETING.sub("", a), ECHO.sub("", GREETING.sub("", a))}:
        head = bare(t[: 64 + 2 * len(q)])
        if len(head) > shortest and not any(head.startswith(f[: len(head)]) for f in forms):
            continue  # starts with something else
        b = bare(t)
        for f in forms:
            at = 0
            while b.startswith(f, at):
                at += len(f)
            rest = b[at:]
            if at and (f.startswith(rest) or rest in NOTHING) or not at and len(b) >= max(4, COPIED * len(f)) and f.startswith(b):
                return True
    return False


def opening(answer: str, query: str | None) -> str:
    """The answer without a repetition of the prompt or its subject before the first statement."""
    t = answer.strip()
    if query and t.startswith(("关于", "About", "Regarding", "针对", "就")):
        m = regex.match(r"(?:关于|针对|就|About|Regarding)\s*(?:[“\"《][^”\"》]*[”\"》]|[^:：，,]{1,80}(?::\s*\p{L}+(?:\s\p{L}+)?)?)\s*[:：，,]\s*", t)
        if m:
            return t[m.end() :]
    return t


def is_refusal(answer: str, query: str | None) -> bool:
    """One of the first two statements declines, and what it declines is to answer."""
    said = [s for s in regex.split(r"(?<=[。！？!?])|(?<=\.)\s", opening(answer, query)) if s and s.strip()]
    return any(REFUSAL.search(s) for s in said[:2])


def _unmarked(text: str) -> str:
    return TAGS.sub(" ", text) if "<" in text or "&" in text or "```" in text else text


def language(text: str) -> str:
    """Language of a text by script and frequent words; '' if it can't be told (numbers, names)."""
    t = NAMED.sub(" ", _unmarked(text))
    han = sum(map(len, HAN_RUN.findall(t)))
    if RARE.search(t):
        n = {k: len(p.findall(t)) for k, p in SCRIPTS.items()}
        if n["kana"] > 1 and n["kana"] * 8 >= han:
            return "ja"
        if n["hangul"] > 1:
            return "ko"
        if n["cyr"] > 3 and n["cyr"] >= n["latin"]:
            return "ru"
        if n["arab"] > 3:
            return "ar"
    if not LATIN_RUN.search(t):
        return "zh" if han else ""
    plain = [w.casefold() for w in LATIN_RUN.findall(TITLE.sub(" ", t))]
    scores = {k: sum(w in v for w in plain) for k, v in WORDS.items()}
    best = max(scores, key=scores.get)
    if han and han >= 2 * len(plain):
        return "zh"
    if best != "en" and scores[best] >= 2 and scores[best] > scores["en"]:
        return best
    if scores["en"] or not han:
        return "en"
    return "zh"


def asked_language(query: str) -> str:
    """Language of a prompt. Course names in it don't count; a single question word decides for English."""
    t = NAMED.sub(" ", query)
    english = ENGLISH.findall(t)
    if len(english) >= 2 or english and not ASKING.search(t):
        return "en"
    return language(t)


def is_other_language(query: str | None, answer: str) -> bool:
    """The answer's language is known and not the prompt's, nor the one the prompt asks for. Names that both share don't count."""
    q = query or ""
    if TRANSLATE.search(q):
        return False
    wanted = next((k for k, p in ASKS if p.search(q)), None) or asked_language(q)
    t = answer
    for name in {*NAMED.findall(q), *(TWO_HAN.findall(q) if wanted == "en" else [m.group().strip() for m in TITLE.finditer(q)])}:
        t = t.replace(name, " ")
    got = language(t)
    return bool(got and wanted) and got != wanted and not names_only(answer, q)


def names_only(answer: str, query: str) -> bool:
    """Whether an answer holds nothing but a name: no sentence mark, no frequent word, or only Latin title words."""
    t = answer.strip().rstrip(".。")
    if HAN_RUN.search(t):
        return bool(regex.fullmatch(r"《[^》]*》", answer.strip()))
    words = LATIN_RUN.findall(t)
    return len(words) > 1 and all(w[0].isupper() or w in ("and", "of", "the", "in", "for") for w in words) and not any(w.casefold() in ("yes", "no", "semester", "not") for w in words)


def last_unit(text: str) -> str:
    """What follows the last final mark."""
    return regex.split(r"[。！？!?…；;\n]|\.(?=\s|$)", text)[-1].strip()


def unclosed(text: str) -> bool:
    """An opening bracket or quotation mark without its closing one, or an odd number of code fences or straight quotes."""
    if text.count("```") % 2:
        return True
    for a, b in PAIRS.items():
        if text.count(a) > text.count(b) and text.rfind(a) > text.rfind(b):
            return True
    return text.count('"') % 2 == 1 and not regex.search(r'\d"', text)


def missing_items(text: str) -> bool:
    """Fewer items than announced, or an announcement with nothing after it."""
    if regex.search(r"[:：]\s*$", text):
        return True
    m = ANNOUNCED.search(text)
    if not m:
        return False
    word = (m.group(1) or m.group(2)).casefold()
    n = int(word) if word.isdigit() else COUNT_WORDS[word]
    rest = text[m.end() :]
    seen = {x for x in ITEM.findall(rest)}
    found = max(len(seen), len(BULLET.findall(rest)))
    return 0 < found < n or not rest.strip() or bool(regex.search(r"(?:^|\s)(?:\d{1,2}|[一二三四五六七八九十])[.、)）]\s*$", text))


ENDS = (6, 4, 3, 2)
DIGIT = regex.compile(r"\d")
#: Shortest keys of undecided endings that are sent to all tasks; where there are more, all endings are counted.
WANTED = 200_000
WORD_OR_HAN = regex.compile(r"([^\W\p{Han}]+(?:['’-][^\W\p{Han}]+)*%?)|\p{Han}+")


def word_keys(word: str, before: str) -> list[str]:
    """What is counted for a word of a script other than Han: it with the word before it, and it alone."""
    return [f" {before} {word} ", f" {word} "] if before else [f" {word} "]


def endings(text: str, wanted: set[str] | None = None) -> Iterator[tuple[str, bool]]:
    """Each place in a text where a word or a Han character ends, as (key, whether a final mark follows). Keys of Han text are the last two to six characters of any kind. `wanted`: the shortest keys of the places to give, all if None."""
    t = DIGIT.sub("0", text)
    before = ""
    for m in WORD_OR_HAN.finditer(t):
        start, end = m.span()
        word = m.group(1)
        if word:
            ends = (end,) if wanted is None or f" {word} " in wanted else ()
        else:
            ends = range(start + 1, end + 1) if wanted is None else [at for at in range(max(start + 1, 2), end + 1) if t[at - 2 : at] in wanted]
        if ends:
            rest = t[end : end + 4].lstrip(TRAIL)
            final = bool(rest) and rest[0] in FINAL and not ELLIPSIS.match(rest[:2]) and not (rest[0] == "." and len(rest) > 1 and rest[1].isdigit())
            for at in ends:
                if word:
                    for k in word_keys(word, before):
                        yield k, final
                else:
                    for k in ENDS:
                        if at >= k:
                            yield t[at - k : at], final and at == end
        before = word or ""


def truncation(answer: str) -> bool | None:
    """Whether an answer stops early; None where that depends on how its last characters are used elsewhere."""
    t = answer.rstrip()
    if unclosed(t) or missing_items(t):
        return True
    body = t.rstrip(TRAIL)
    if ELLIPSIS.search(body):
        body = ELLIPSIS.sub("", body).rstrip(TRAIL)
        return bool(body) and body[-1] not in FINAL
    if not body or body[-1] in FINAL:
        return False
    if regex.search(r"[，,、;；:：\-–—]$", body):
        return True
    if regex.search(r"(?m)^\s*(?:[-*•·|#]).*$", t.split("\n")[-1]) and len(BULLET.findall(t)) > 1:
        return False  # the last entry of a list needs no mark
    unit = last_unit(body)
    latin = not regex.search(r"\p{Han}", unit[-3:]) and bool(regex.search(r"\p{Latin}", unit))
    words = regex.findall(r"[\p{L}\p{N}'’%-]+", unit) if latin else []
    if words and words[-1].casefold() in DANGLING_EN or not latin and len(unit) > 2 and DANGLING_ZH.search(unit):
        return True
    if unit == body and (len(unit) < 12 if not latin else len(words) <= 4 or TITLE.fullmatch(unit)):
        return False  # a bare value
    return None


def last_endings(answer: str) -> list[str]:
    """The keys of the place where an answer ends, longest first."""
    e = DIGIT.sub("0", answer.rstrip().rstrip(TRAIL))
    words = list(WORD_OR_HAN.finditer(e))
    if not words:
        return []
    if words[-1].group(1):
        return word_keys(words[-1].group(1), words[-2].group(1) or "" if len(words) > 1 else "")
    end = words[-1].end()
    return [e[end - k : end] for k in ENDS if end >= k]


def ending_table(answers: DataFrame, wanted: set[str] | None = None, support: int = 5, sure: int = 20) -> DataFrame:
    """(ending, share, unsure) of every ending seen `support` times or more, over all answers; those seen less than `sure` times are only used where there is no other. `wanted` limits the endings to those that are asked for."""
    shared = answers.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: dict[str, list[int]] = {}
            for t in b["answer"]:
                for e, final in endings(t, shared.value):
                    c = counts.setdefault(e, [0, 0])
                    c[0] += 1
                    c[1] += final
            yield pd.DataFrame([(e, n, f) for e, (n, f) in counts.items()], columns=["ending", "n", "f"])

    found = answers.mapInPandas(run, "ending string, n long, f long").groupBy("ending").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    return found.where(F.col("n") >= support).select("ending", (F.col("f") / F.col("n")).alias("share"), (F.col("n") < sure).alias("unsure"))


def flag(df: DataFrame, key: str = "query_id", query: str = "query", answer: str = "answer", least_share: float = 0.1) -> DataFrame:
    """(key, defects) of every defective pair: all defects that hold, in ORDER.

    A null answer is empty; a null or blank query can't be copied and has no language. Rows of one key are alike but for their arrival and count once; of rows that differ, the one with the smallest (query, answer) stays. Rows without a key are left out. Whole texts are read, however long."""
    steps = Steps(df.sparkSession)
    pairs = first_by(df.where(F.col(key).isNotNull()).select(F.col(key), F.col(query).alias("query"), F.col(answer).alias("answer")), [key], F.col("query"), F.col("answer"))
    pairs = steps.write(pairs)

    def rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, open_ = [], []
            for q, a in zip(b["query"], b["answer"]):
                d: list[str] = []
                ends: list[str] = []
                if is_empty(a):
                    d.append("empty")
                else:
                    if is_copy(q, a):
                        d.append("copy")
                    if is_refusal(a, q):
                        d.append("refusal")
                    if is_other_language(q, a):
                        d.append("other_language")
                    stops = truncation(a)
                    if stops:
                        d.append("truncated")
                    elif stops is None:
                        ends = last_endings(a)
                found.append(d)
                open_.append(ends)
            yield pd.DataFrame({key: b[key], "defects": found, "ends": open_})

    schema = T.StructType([df.schema[key], T.StructField("defects", T.ArrayType(T.StringType())), T.StructField("ends", T.ArrayType(T.StringType()))])
    judged = steps.write(pairs.mapInPandas(rules, schema).where("size(defects) > 0 or size(ends) > 0"))
    asked = judged.where("size(ends) > 0").select(key, F.posexplode("ends").alias("pos", "ending"))
    short = asked.groupBy(key).agg(F.max_by("ending", "pos").alias("ending")).select("ending").distinct().limit(WANTED + 1).collect()
    wanted = {r["ending"] for r in short} if len(short) <= WANTED else None  # the same shares either way
    shares = steps.write(ending_table(pairs.where("answer is not null").select("answer"), wanted))
    told = join_lookup(asked, shares, "ending", "left").groupBy(key).agg(F.min_by("share", F.when(F.col("share").isNotNull(), F.struct("unsure", "pos"))).alias("share"))
    late = told.where(F.coalesce("share", F.lit(0.0)) < least_share).select(key, F.lit(True).alias("late"))
    whole = judged.join(late, key, "left").select(key, F.when(F.col("late"), F.array_append("defects", F.lit("truncated"))).otherwise(F.col("defects")).alias("defects"))
    return whole.where("size(defects) > 0")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and main defect of every defective answer."""
    return flag(table(spark, sf_dir, "query_log")).select("query_id", F.col("defects")[0].alias("defect"))


def p4_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect of every defective answer."""
    return flag(table(spark, sf_dir, "query_log")).select("query_id", F.explode("defects").alias("defect"))


QUERIES = {"p4_found": p4_found, "p4_defects": p4_defects}
SQL: dict[str, str] = {}
