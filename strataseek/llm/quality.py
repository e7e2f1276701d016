"""Text quality of documents: exact statistics, per-language tail probabilities, and a verdict on natural prose."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataseek.operators.skew import join_facts
from strataseek.runtime import materialise

# Classes of function words, by which word order is judged. A determiner is not followed by another
# function word, a preposition not by one of the last two classes, and neither ends a sentence.
DETERMINERS = {
    "en": "the a an this every each",
    "de": "der die das den dem eine ein jede einer",
    "fr": "le la les des du une un chaque cette l",
    "es": "el la los las del una un cada al esta",
}
PREPOSITIONS = {"en": "of in to for by with on at from into during", "de": "am im bei mit für von nach vor", "fr": "de dans pour sans avec en", "es": "de en para sin con"}
ELIDED = {"fr"}
OTHERS = {"en": "and but is was because since while when if that so as it we", "de": "und aber wenn weil", "fr": "et mais que qui quand", "es": "y pero que cuando se"}

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+")
_GAPS = re.compile(r"([^\W\d_]+(?:['’][^\W\d_]+)?|\d+)")
#: The commonest gaps between words that end a sentence, and that do not; ``_STOP`` tells the others.
_STOPS = frozenset((". ", "! ", "? ", "。"))
_GOES_ON = frozenset((", ", "; ", ": ", "-", ",", ".", "/", "_", " (", ") ", "), ", "'", "’", " - ", " – ", "="))
_STOP = re.compile(r"[.!?][\"'”»)\]]*(?:\s|\Z)|[。！？]")
#: Lines of words and the commonest marks only, as prose mostly is; the tests for other kinds of lines need not look at them.
_PLAIN = re.compile(r"\s*[^\W\d_][\w ,.!?'’%-]*\Z")
_PLAIN_CODE = ("import ", "from ", "package ", "return", "SELECT ", "INSERT ", "UPDATE ", "DELETE ", "CREATE ", "FROM ", "WHERE ", "GROUP BY", "ORDER BY")
_HAN = re.compile(r"[\u3400-\u9fff\uf900-\ufaff]")
_HANS = re.compile(r"[\u3400-\u9fff\uf900-\ufaff]+")
_SENTENCE = re.compile(r"[^.!?。！？]*(?:[.!?](?=\S)[^.!?。！？]*)*[.!?。！？]*[\"'”»)\]]*\s*")
_BULLET = re.compile(r"\s*(?:[-*+•–·▪◦]|\(?\d{1,4}[.)]|[a-zA-Z][.)])\s+")
_TABULAR = re.compile(r"\t|^\s*\||\S\s\|\s\S|\s[»›]\s|\s>\s|\s[;¦]\s|\.{4,}|(?:\S\s{3,}\S.*){2}")
_LOG = re.compile(r"^\s*\[?(?:\d{4}[-/]\d\d[-/]\d\d|\d\d:\d\d:\d\d|[A-Z][a-z]{2} +\d+ \d\d:)|\b(?:DEBUG|INFO|WARN(?:ING)?|ERROR|TRACE|FATAL)\b.*[=\[\]]|^[^=]*\b\w+=\S+ \w+=\S+")
_CODE = re.compile(
    r"[{};]\s*$|^\s*[\])}]+[;,]?$|^\s*(?:for|if|elif|while|else|try|with)\b.*[:{]\s*$|^\s*(?:def|class|func|function|fn|interface|struct|enum)\b.*[({:]|^\s*(?:const|let|var|export|public|private|static)\s+\w+.*[=({;]"
    r"|^\s*from\s+[\w.]+\s+import\b|^\s*import\s+[\w.\"{*]+(?:\s+as\s+\w+)?$|^\s*package\s+[\w.]+$|^\s*return\b(?:\s+[\w.\[\]]+)?;?$|^\s*(?://|/\*|\*/|#include|#!|@\w+$)"
    r"|:=|=>|==|&&|\|\||^\s*[\w.\[\]\"']+\s*[+*/-]?=\s*\S|^\s*[{\[].*[:,].*[}\]],?$|^\s*[\w.]+\([^()]*\)$|^\s*(?:SELECT|INSERT|UPDATE|DELETE|CREATE|FROM|WHERE|GROUP BY|ORDER BY)\s"
)
_PATH = re.compile(r"(?:[\w.-]+/){2,}[\w.-]+|[A-Za-z]:\\\S+|https?://\S+")
_MARKS = frozenset(".!?。！？…:;")
_CLOSERS = "\"'”»)]"
#: What ends a sentence inside a text, as counted for ``sentence_rate``.
_ENDINGS = tuple(x.encode() for x in (". ", ".\n", "! ", "!\n", "? ", "?\n", "。", "！", "？"))
_DIGITS = b"0123456789"
_SYMBOLS = bytes(i for i in range(33, 127) if not chr(i).isalnum())
#: Statistics that are ranked, each with a share between 0 and 1 and the tail that speaks against prose: -1 low, 1 high.
TAILS = {"common_share": -1, "sentence_rate": -1, "repeated_share": 1, "wrong_order_share": 1, "symbol_ratio": 1}
#: Ranked values are rounded to this many digits, so a language has at most 10,001 of each.
DIGITS = 4
DESCRIBED = ["n_words", "n_lines", "mean_word_length", "digit_ratio", "end_punct_share", "short_line_share"]
STATS = [*DESCRIBED, *TAILS]


def _schema(describe: bool) -> str:
    return ", ".join(f"{s} {'long' if s[:2] == 'n_' else 'double'}" for s in (STATS if describe else TAILS))


def _ends(line: str) -> bool:
    """Whether a line ends as a sentence does, closing quotes and brackets aside."""
    return line.rstrip().rstrip(_CLOSERS).rstrip()[-1:] in _MARKS and bool(line)


class Judge:
    """Tells sentences from lists, tables, code, logs, menus, noise and scrambled words."""

    def __init__(self, common: dict[str, list[str]]):
        self.common = {x: frozenset(w) for x, w in common.items()}
        self.names = sorted(common)
        self.any = frozenset(w for x in common.values() for w in x)
        cls = lambda t, x: frozenset(t.get(x, "").split())
        self.det = {x: cls(DETERMINERS, x) for x in common}
        self.prep = {x: cls(PREPOSITIONS, x) for x in common}
        self.rest = {x: cls(OTHERS, x) for x in common}
        self.lead = {x: self.det[x] | self.prep[x] for x in common}
        self.after_det = {x: self.rest[x] | self.prep[x] | self.det[x] for x in common}
        self.after_prep = {x: self.rest[x] | self.prep[x] for x in common}

    def language(self, words: list[str]) -> str | None:
        """The language whose common words a text holds most of."""
        words = [w for w in words if w in self.any]
        best, most = None, 0
        for x in self.names if words else ():
            n = sum(map(self.common[x].__contains__, words))
            if n > most:
                best, most = x, n
        return best

    def hits(self, words: list[str], language: str) -> int:
        """Common words of a language among words, elided articles included."""
        n = sum(map(self.common[language].__contains__, words))
        return n + sum(w[1:2] in "'’" and len(w) > 2 for w in words) if language in ELIDED else n

    def order(self, words: list[str], language: str | None) -> float:
        """Share of determiners and prepositions that another function word follows which cannot."""
        if not language or not self.lead[language]:
            return 0.0
        lead, det, after_det, after_prep = self.lead[language], self.det[language], self.after_det[language], self.after_prep[language]
        followed = [(a in det, b) for a, b in zip(words, [*words[1:], ""], strict=True) if a in lead]
        return sum([b in (after_det if d else after_prep) for d, b in followed]) / len(followed) if followed else 0.0

    def sentence(self, words: list[str], gaps: list[str], size: int, language: str | None = None) -> int:
        """1 for a natural sentence (or several without marks between), -1 for its words in a wrong order, else 0.

        ``words``: lower case; ``gaps``: what follows each; ``size``: its
        characters, blanks apart. ``language`` is that of the paragraph, for
        sentences without common words of their own.
        """
        n = len(words)
        joined = "".join(words)
        if n < 4 or len(joined) < 0.6 * size or (size > 45 and max(map(len, words)) > 45):
            return 0
        hits = self.hits(words, language) if language else 0
        plain = n if joined.isalpha() else n - sum(map(str.isdigit, words))
        if hits * 6 < plain:
            own = self.language(words)
            if own and own != language:
                language, hits = own, max(hits, self.hits(words, own))
        if not language:
            return 0
        if hits * 14 < plain or plain < 4 or plain * 2 < n:
            return 0
        lead, det, prep, rest = self.lead[language], self.det[language], self.prep[language], self.rest[language]
        seen = bad = 0
        for i in [i for i, a in enumerate(words) if a in lead]:
            b = words[i + 1] if i + 1 < n else ""
            if b and not gaps[i].isspace():
                continue  # a mark between them
            seen += 1
            a = words[i]
            bad += b in rest or (b in prep and a != "from") or (a in det and (not b or b in det))
        return 1 if (bad <= 1 + 0.08 * seen if seen > 8 else bad * 4 <= seen) else -1

    def natural(self, text: str) -> tuple[int, int]:
        """Characters, white space apart, in distinct natural sentences, and in sentences of words in a wrong order."""
        total = scrambled = 0
        seen: set[str] = set()
        block: list[str] = []

        def close() -> int:
            nonlocal scrambled
            if not block:
                return 0
            k = len(block)
            if k > 2 and sorted(map(len, block))[k // 2] < 32 and sum(map(_ends, block)) * 3 < k and not _HAN.search(block[0]):
                block.clear()
                return 0  # menus: short lines that do not end as sentences do
            para = " ".join(block)
            block.clear()
            if not para.isascii():
                han = sum(map(len, _HANS.findall(para)))
                if han and han * 4 > len(para) - para.count(" "):
                    return chinese(para)
            parts = _GAPS.split(para.lower())
            words, gaps = parts[1::2], parts[2::2]
            if not words:
                return 0
            plain = words if "".join(words).isalpha() else [w for w in words if not w.isdigit()]
            language = self.language(plain)
            if len(plain) > 14 and language and self.hits(plain, language) * 16 < len(plain):
                return 0  # noise that holds a common word by chance
            good = wrong = 0
            gaps[-1] += " "
            stops = [i + 1 for i, g in enumerate(gaps) if g != " " and (g in _STOPS or (g not in _GOES_ON and _STOP.search(g)))]
            if stops[-1:] != [len(words)]:
                stops.append(len(words))
            at = 0
            for to in stops:
                mine = words[at:to]
                key = " ".join(mine)
                if key not in seen:
                    seen.add(key)
                    whole = "".join(parts[2 * at + 1 : 2 * to + 1])
                    chars = len(whole) - whole.count(" ")
                    verdict = self.sentence(mine, gaps[at:to], chars, language)
                    if verdict:
                        good, wrong = (good + chars, wrong) if verdict > 0 else (good, wrong + chars)
                at = to
            scrambled += wrong
            return 0 if wrong * 4 >= good else good  # a scrambled paragraph has sentences that look right by chance

        def chinese(para: str) -> int:
            good = 0
            for m in _SENTENCE.finditer(para):
                s = m.group(0).strip()
                key = s.rstrip(".!?。！？ ").lower()
                if s and key not in seen:
                    seen.add(key)
                    size = len(s) - s.count(" ")
                    han = sum(map(len, _HANS.findall(s)))
                    if han * 2 > size:
                        good += size * (han >= 6 and not _TABULAR.search(s))
                    else:
                        parts = _GAPS.split(s.lower())
                        good += size * (self.sentence(parts[1::2], parts[2::2], size) > 0)
            return good

        fenced = False
        for line in text.split("\n"):
            bare = line.strip()
            if not fenced and _PLAIN.match(line) and not bare.startswith(_PLAIN_CODE) and "...." not in line and "   " not in bare and " " in bare:
                block.append(bare)
            elif bare.startswith("```"):
                fenced = not fenced
                total += close()
            elif fenced or not bare:
                total += close()
            elif _BULLET.match(line):
                total += close()
                item = line[_BULLET.match(line).end() :]
                if len(item.split()) >= 12 and _ends(item):
                    block.append(item)
                    total += close()
            elif _TABULAR.search(line) or _LOG.search(line) or _CODE.search(line) or sum(len(x) for x in _PATH.findall(line)) * 2 > len(bare) or (" " not in bare and len(bare) > 30 and not _HAN.search(bare)):
                total += close()
            else:
                block.append(bare)
        total += close()
        return total, scrambled


def ranked(text: str, judge: Judge) -> tuple:
    """The values of ``TAILS`` for one text, none of which looks at its sentences; an empty text has zeros throughout.

    Words are what stands between white space. Line ends must be LF.
    """
    low = text.lower().split()
    if not low:
        return (0.0,) * len(TAILS)
    size = sum(map(len, low))
    raw = text.encode("utf-8", "replace")
    hits = [w for w in low if w in judge.any]
    language = judge.language(hits) if hits else None
    if language:
        common = sum(map(judge.common[language].__contains__, hits)) / len(low)
    else:
        common = 0.3 if len(raw) > len(text) and 2 * sum(map(len, _HANS.findall(text))) > size else 0.0
    parts = [x for x in text.replace(". ", ".\n").split("\n") if x and not x.isspace()]
    closed = raw + b"\n"
    ends = sum(map(closed.count, _ENDINGS if len(raw) > len(text) else _ENDINGS[:6]))
    return (common, ends / size, 1 - len(set(parts)) / len(parts), judge.order(low, language), (len(raw) - len(raw.translate(None, _SYMBOLS))) / size)


def described(text: str) -> tuple:
    """The values of ``STATS`` beside the ranked ones. A Han character is a word; line ends must be LF."""
    lines = [y for x in text.split("\n") if (y := x.strip())]
    if not lines:
        return (0, 0, 0.0, 0.0, 0.0, 0.0)
    words = text.split()
    size, k = sum(map(len, words)), len(lines)
    raw = text.encode("utf-8", "replace")
    n = len(words) + (0 if len(raw) == len(text) else sum(map(len, _HANS.findall(text))))
    ended = list(map(_ends, lines))
    return (n, k, size / n, (len(raw) - len(raw.translate(None, _DIGITS))) / size, sum(ended) / k, sum(len(x) < 32 and not e for x, e in zip(lines, ended, strict=True)) / k)


def natural_share(text: str, judge: Judge) -> float:
    """Share of the characters of a text, white space apart, that stand in natural sentences. Line ends must be LF."""
    size = sum(map(len, text.split()))
    return judge.natural(text)[0] / size if size else 0.0


def _lf(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def word_lists(common_words: DataFrame) -> dict[str, list[str]]:
    """Common words per language; a fixed table of some hundred rows."""
    rows = common_words.where("lang IS NOT NULL AND word IS NOT NULL").groupBy("lang").agg(F.sort_array(F.collect_set(F.lower("word"))).alias("words")).collect()
    return {r.lang: r.words for r in rows}


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def ranked_values(documents: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """grp (the language), stat, value, n: how often each rounded value of a ranked statistic occurs.

    Each task counts its own rows before anything is shuffled.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(common)
        seen: Counter[tuple[str, str, float]] = Counter()
        for batch in batches:
            for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True):
                seen.update([(lang, s, round(v, DIGITS)) for s, v in zip(TAILS, ranked(_lf(text), judge), strict=True)])
            if len(seen) > 200_000:
                yield _batch([*zip(*((*k, n) for k, n in seen.items()), strict=True)], types)
                seen.clear()
        yield _batch([*zip(*((*k, n) for k, n in seen.items()), strict=True)], types)

    types = {"grp": pa.string(), "stat": pa.string(), "value": pa.float64(), "n": pa.int64()}
    counts = _texts(documents).select("lang", "text").mapInArrow(measure, "grp string, stat string, value double, n long")
    return counts.groupBy("grp", "stat", "value").agg(F.sum("n").alias("n"))


def tail_probabilities(counted: DataFrame, partitions: int) -> DataFrame:
    """Exact empirical tails per group: grp, stat, value, n, left = P(X <= value), right = P(X >= value).

    ``counted``: grp, stat, value (each once) and the number ``n`` of its
    rows. The values are sorted by range partitioning; a rank is the running
    count within its partition plus the offset of that partition, the counts
    of the partitions before it in the same group. No task sees a whole group.
    """
    ranged = counted.repartitionByRange(partitions, "grp", "stat", "value").withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged.sortWithinPartitions("grp", "stat", "value"))
    sums = ranged.groupBy("grp", "stat", "part").agg(F.sum("n").alias("n_part"))
    whole = Window.partitionBy("grp", "stat")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("grp", "stat", "part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("before"), F.sum("n_part").over(whole).alias("total"))
    within = Window.partitionBy("grp", "stat", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranks = ranged.withColumn("upto", F.sum("n").over(within)).join(offsets, ["grp", "stat", "part"])
    upto = F.col("before") + F.col("upto")
    return ranks.select("grp", "stat", "value", "n", (upto / F.col("total")).alias("left"), ((F.col("total") - upto + F.col("n")) / F.col("total")).alias("right"))


#: Truncated product: a tail probability above this says nothing and adds nothing to the score.
TAIL_MAX = 0.3
#: Documents from this score on are picked: one statistic among the outer 30 % of its language, or several further in.
OUTLIER_MIN = -math.log(TAIL_MAX) - 1e-9
#: A language of fewer documents is ranked among all documents.
LANGUAGE_MIN = 20
#: Tails of up to this number of languages are handed to every task at once; a language has at most 10,001 values of each
#: ranked statistic. Beyond it, scores are joined by shuffle.
LANGUAGES_MAX = 40
#: The group of all documents.
ALL = "*"


def verdicts(documents: DataFrame, common: dict[str, list[str]], least: float = OUTLIER_MIN, describe: bool = True) -> DataFrame:
    """doc_id, lang ('und' for null), STATS, outlier, natural_share, is_prose for every document.

    Without ``describe`` the statistics are only those of TAILS.

    ``documents``: doc_id (unique), lang, text. ``outlier`` is the sum of -ln
    of the tail probabilities up to TAIL_MAX of the ranked statistics, each
    ranked exactly among the documents of the same language (of all, where it
    has fewer than LANGUAGE_MIN), on the side that speaks against prose. A
    document that stands out (``least``) is then read sentence by sentence:
    it is no prose if less than half of its characters stand in natural
    sentences. The others are prose, with a null ``natural_share``. The texts
    are read twice and, up to LANGUAGES_MAX languages, never shuffled.

    One row per input row. A null text counts as empty; an empty text is no
    prose; an empty table gives an empty result; other columns are ignored.
    """
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    counted = materialise(ranked_values(documents, common))
    whole = counted.groupBy(F.lit(ALL).alias("grp"), "stat", "value").agg(F.sum("n").alias("n"))
    languages = counted.where((F.col("stat") == next(iter(TAILS))) & (F.col("grp") != ALL)).groupBy("grp").agg(F.sum("n").alias("__n")).where(F.col("__n") >= LANGUAGE_MIN).select("grp")
    languages = materialise(languages)
    tails = tail_probabilities(counted.join(languages, "grp").unionByName(whole), partitions)
    side = F.create_map(*(F.lit(x) for s in TAILS.items() for x in s))[F.col("stat")]
    tail = F.when(side < 0, F.col("left")).otherwise(F.col("right"))
    points = materialise(tails.select("grp", "stat", "value", "n", F.when(tail <= TAIL_MAX, -F.log(tail)).otherwise(0.0).alias("points")))
    rows = _texts(documents)
    out = f"doc_id {dict(rows.dtypes)['doc_id']}, lang string, {_schema(describe)}, outlier double, natural_share double, is_prose boolean"
    named = [r.grp for r in languages.limit(LANGUAGES_MAX + 1).collect()]
    if len(named) <= LANGUAGES_MAX:
        known: dict[str, dict[str, dict[float, float]]] = {x: {} for x in (ALL, *named)}
        for r in points.where("points > 0").collect():
            known[r.grp].setdefault(r.stat, {})[r.value] = r.points
        shared = documents.sparkSession.sparkContext.broadcast(known)

        def look_up(batch: pa.RecordBatch, values: list[tuple]) -> list[float]:
            known = shared.value
            return [_score(known[lang if lang in known else ALL], v) for lang, v in zip(batch.column("lang").to_pylist(), values, strict=True)]

        return rows.mapInArrow(partial(_judge, common=common, least=least, describe=describe, score=look_up), out)
    values = rows.mapInArrow(partial(_values, common=common), f"doc_id {dict(rows.dtypes)['doc_id']}, lang string, stat string, value double")
    values = values.join(languages.select(F.col("grp").alias("lang"), "grp"), "lang", "left").withColumn("grp", F.coalesce("grp", F.lit(ALL)))
    values = materialise(values)
    scores = join_facts(values, points, ["grp", "stat", "value"], "n", values.count()).groupBy("doc_id").agg(F.sum("points").alias("outlier"))
    return rows.join(scores, "doc_id").mapInArrow(partial(_judge, common=common, least=least, describe=describe, score=lambda batch, _: batch.column("outlier").to_pylist()), out)


def _batch(columns: list, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = columns or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


def _score(points: dict[str, dict[float, float]], values: tuple) -> float:
    return sum(points.get(s, {}).get(round(v, DIGITS), 0.0) for s, v in zip(TAILS, values, strict=True))


def _values(batches: Iterator[pa.RecordBatch], common: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
    judge = Judge(common)
    for batch in batches:
        ids, langs, texts = (batch.column(c) for c in ("doc_id", "lang", "text"))
        values = [ranked(_lf(t), judge) for t in texts.to_pylist()]
        k = len(TAILS)
        at = pa.array([i for i in range(len(ids)) for _ in range(k)], pa.int32())
        yield pa.RecordBatch.from_arrays([ids.take(at), langs.take(at), pa.array(list(TAILS) * len(ids), pa.string()), pa.array([round(x, DIGITS) for v in values for x in v], pa.float64())], names=["doc_id", "lang", "stat", "value"])


def _judge(batches: Iterator[pa.RecordBatch], common: dict[str, list[str]], least: float, describe: bool, score: Callable[[pa.RecordBatch, list[tuple]], list[float]]) -> Iterator[pa.RecordBatch]:
    judge = Judge(common)
    types = {s: pa.int64() if s[:2] == "n_" else pa.float64() for s in (STATS if describe else TAILS)}
    for batch in batches:
        texts = [_lf(t) for t in batch.column("text").to_pylist()]
        values = [ranked(t, judge) for t in texts]
        scores = score(batch, values)
        shares = [natural_share(t, judge) if x >= least or not t or t.isspace() else None for t, x in zip(texts, scores, strict=True)]
        full = ((*described(t), *v) for t, v in zip(texts, values, strict=True)) if describe else values
        stats = _batch([*zip(*full, strict=True)], types)
        verdict = [pa.array([round(x, 6) for x in scores], pa.float64()), pa.array(shares, pa.float64()), pa.array([x is None or x >= 0.5 for x in shares], pa.bool_())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *stats.columns, *verdict], names=["doc_id", "lang", *types, "outlier", "natural_share", "is_prose"])
