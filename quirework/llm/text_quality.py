"""Per-document text quality statistics, and telling prose from lists, tables and junk.

Gradient-boosted trees look at the statistics of each line in its document (length, symbol and digit shares, endings, list marks,
cells, share of common words, and how much of the document has the same shape) and give the probabilities of prose, list
entry, table row and junk. They are trained on lines that plain rules label with confidence (weak labels; lines on which
the rules are silent are not used), from a sample of at most ``SAMPLE_CHAPTERS`` texts chosen by hash, and calibrated on
lines of real chapters that were read and labelled by hand (``HAND_CHECKED``; see ``calibration``). A document is what more than half of its non-empty lines are. All counts and
statistics cover whole texts; word and character counts are JVM expressions.

Defined results: null text -> no statistics (no row); empty or blank text -> zero lines, kind ``prose`` with shares 0; extra
columns are ignored; repeated rows give repeated results; an empty table gives an empty table (trees trained on EXAMPLES).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm import mojibake
from quirework.llm.boosting import BoostedTrees

KINDS = ("prose", "list", "table", "junk")
SAMPLE_CHAPTERS = 1500
SAMPLE_LINES = 24_000

_WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")
_ENDS = re.compile(r"[.!?…;:]?[”\"»“’')\]]*$")
_SENTENCE = re.compile(r"[.!?…:;][”\"»“’')\]]*\s*$")
_FULL_STOP = re.compile(r"[.!?…][”\"»“’')\]]*\s*$")
_BULLET = re.compile(r"\s*[•*▪‣◦·○●□+]\s+")
_DASH = re.compile(r"\s*[-–—―]\s+")
_NUMBER = re.compile(r"\s*(?:\(?\d{1,4}[.)]|\(?[a-zA-Z][.)]|[ivxIVX]+[.)])\s+")
_QUANTITY = re.compile(r"\s*(?:\d+(?:[.,/]\d+)?|[½¼¾⅓⅔])\s*(?:×|x|g|kg|ml|l|dl|cl|EL|TL|c|tsp|tbsp|cups?)?\s+[^\W\d_]")
_LEADER = re.compile(r"(?:\.\s?){4,}\s*\d+\s*$|_{4,}\s*\d+\s*$")
_LAST_NUMBERS = re.compile(r"(?:,\s*\d+(?:[-–]\d+)?)+\s*$")
_LAST_NUMBER = re.compile(r"\d\s*$")
_REFERENCE = re.compile(r"^\s*[^\W\d_][\w’'-]+(?:\s[\w’'-]+)?,\s(?:[^\W\d_]\.\s?)+.*\b\d{4}[a-z]?\.?\s*$")
_GAP = re.compile(r"\S {2,}(?=\S)|\t")
_CODE = re.compile(r"[{}=<>()\\^~`#@$\[\]|*_]")
_RULED = re.compile(r"^[\s│|├┤┼┬┴┌┐└┘─━═+:\-]+$")
_STATEMENT = re.compile(r"^\s*(?:[.#@]?[\w-]+(?:\s*[,>]\s*[\w.#-]+)*\s*\{.*\}?|var\s|function\b|let\s|const\s|if\s*\(|return\b|[\w.]+\(.*\);|<\/?\w+)")
_VOWELS = frozenset("aeiouyáàâäãåæéèêëíìîïóòôöõøœúùûüýąęıαεηιουωάέήίόύώаеёиоуыэюяіїє")


#: statistics of a line, in order; the last five describe the document around it
STATISTICS = (
    "log_length words letters digits symbols spaces ends_sentence ends_full_stop starts_upper bullet dash number quantity share_common mean_word "
    "odd_words pipes tabs gaps semicolons leader last_number page_numbers reference code top_character distinct_tokens statement ruled navigation "
    "longest_token consonants first_line same_shape same_cells document_common document_stops document_code"
).split()
_AT = {name: i for i, name in enumerate(STATISTICS)}
_CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]{4,}|[^\W\d_]*[bcdfghjkmpqtvwxz]{2}\b(?<=[jqvwx][bcdfghjkmpqtvwxz])")
_NAVIGATION = re.compile(r"(?:<<|>>|\|\||\[[^\]]{0,6}\]|\^\w*|p\.?\d+|pg|nxt|next|prev|top|home|back|menu|up)$", re.I)
_DIGIT = re.compile(r"\d")


class _Words(dict):
    """Word -> letters if it is common, whether its shape is odd, and its mashed consonants, as one number whose sums don't mix; filled as words are met."""

    def __init__(self, common: frozenset[str]):
        super().__init__()
        self.common = common

    def __missing__(self, word: str) -> int:
        low = word.lower()
        odd = not (word.islower() or word.isupper() or word[1:].islower()) or len(word) > 2 and _VOWELS.isdisjoint(low)
        value = (len(word) if low in self.common else 0) + (int(odd) << 32) + (len(_CONSONANTS.findall(low)) << 60)
        if len(self) < 500_000:  # a bound of memory; further words are looked at again each time
            self[word] = value
        return value


class _Tokens(dict):
    """Token -> whether it is a part of a navigation bar; filled as tokens are met."""

    def __missing__(self, token: str) -> bool:
        value = bool(_NAVIGATION.match(token))
        if len(self) < 500_000:
            self[token] = value
        return value


_KNOWN: dict[frozenset[str], _Words] = {}
_NAVIGATES = _Tokens()


def line_statistics(lines: list[str], common: frozenset[str]) -> np.ndarray:
    """One row of statistics per line of one document (``lines`` are its non-empty lines); every statistic is measured on the whole line."""
    rows, shapes = [], []
    if common not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[common] = _Words(common)
    of_word, navigates = _KNOWN[common].__getitem__, _NAVIGATES.__getitem__
    for at, line in enumerate(lines):
        n = len(line)
        words, tokens = _WORD.findall(line), line.split()
        letters, count = sum(map(len, words)), len(words)
        value = sum(map(of_word, words))
        known, odd, mashed = value & 0xFFFFFFFF, value >> 32 & 0xFFFFFFF, value >> 60
        digits = len(_DIGIT.findall(line))
        spaces = line.count(" ") + line.count("\t") + line.count("\xa0") + line.count("\u2003") + line.count("\u3000")
        end = line.rstrip()[-12:]
        full_stop = bool(_FULL_STOP.search(end))
        first = words[0][0] if words else "a"
        pipes, tabs, semis = line.count("|") + line.count("│"), line.count("\t"), line.count(";")
        gaps = len(_GAP.findall(line)) if "  " in line or tabs else 0
        top = Counter(line.replace(" ", "")).most_common(1)[0][1] / n if letters < n * 0.5 else 0.1
        bullet, dash, number, quantity = bool(_BULLET.match(line)), bool(_DASH.match(line)), bool(_NUMBER.match(line)), bool(_QUANTITY.match(line))
        leader = bool(_LEADER.search(line)) if ".." in line or ". ." in line or "__" in line else False
        numbers = line.count(",") if digits and _LAST_NUMBERS.search(line) else 0
        reference = digits >= 4 and bool(_REFERENCE.match(line))
        ruled, statement = bool(_RULED.match(line)), bool(_STATEMENT.match(line))
        navigation = sum(map(navigates, tokens)) / max(1, len(tokens))
        code = len(_CODE.findall(line)) / n if letters + spaces + digits < n else 0.0
        shape = (
            "ruled" if ruled else "navigation" if navigation > 0.5 else "pipe" if pipes > 1 else "tab" if tabs else "gap" if gaps > 1
            else "semi" if semis > 1 and count < 4 * (semis + 1) else "bullet" if bullet else "dash" if dash else "number" if number or quantity
            else "leader" if leader else "numbers" if numbers else "reference" if reference else "code" if statement else "text"
        )
        shapes.append((shape, max(pipes, tabs, gaps, semis) if shape in ("pipe", "tab", "gap", "semi") else 0))
        rows.append([
            math.log1p(n), count, letters / n, digits / n, (n - letters - digits - spaces) / n, spaces / n, full_stop or bool(_SENTENCE.search(end)), full_stop, first.isupper(),
            bullet, dash, number, quantity, known / max(1, letters), letters / max(1, count), odd / max(1, count), pipes, tabs, gaps, semis, leader, bool(_LAST_NUMBER.search(end)), numbers,
            reference, code, top, len(set(tokens)) / max(1, len(tokens)), statement, ruled, navigation, max(map(len, tokens), default=0), mashed / max(1, count), at == 0,
        ])
    if not rows:
        return np.zeros((0, len(STATISTICS)))
    x = np.array(rows, float)
    kinds, exact, total = Counter(s for s, _ in shapes), Counter(shapes), len(lines)
    context = np.array([[kinds[s] / total, exact[s, c] / total if c else 0.0] for s, c in shapes], float)
    whole = np.tile([x[:, _AT["share_common"]].mean(), x[:, _AT["ends_full_stop"]].mean(), x[:, _AT["code"]].mean()], (total, 1))
    return np.hstack([x, context, whole])


def weak_label(line: str, row: np.ndarray) -> int:
    """Kind of a line by plain rules, -1 where they are silent."""
    r = dict(zip(STATISTICS, row))
    ruled_box = "│" in line or "├" in line or "┼" in line or "|" in line
    if r["ruled"]:
        return 2 if ruled_box or (r["same_shape"] < 0.2 and r["document_common"] < 0.1 and r["document_code"] < 0.1) else 3
    if r["navigation"] > 0.5 or r["statement"] and r["code"] > 0.02 or r["code"] > 0.3:
        return 3
    if r["semicolons"] > 1 and r["same_cells"] > 0.3 and r["consonants"] < 0.3:
        return 2
    if r["longest_token"] > 30 and r["share_common"] < 0.1 and r["words"] > 0 and not r["leader"] and r["odd_words"] > 0:
        return 3
    if r["symbols"] > 0.2 and r["mean_word"] < 2.6 and not r["tabs"] and r["same_cells"] < 0.5 and r["digits"] < 0.4 and not r["gaps"] > 1:
        return 3
    if r["share_common"] < 0.05 and r["words"] >= 2 and (r["consonants"] >= 0.3 or r["odd_words"] > 0.5) and not r["tabs"] and not r["pipes"]:
        return 3
    if (r["pipes"] > 1 and line.strip()[0] in "|│" or r["tabs"] or r["gaps"] > 1) and r["same_shape"] > 0.2:
        return 2
    if r["leader"] or r["reference"] or r["bullet"] or r["page_numbers"] and r["digits"] > 0.04:
        return 1
    if (r["number"] or r["quantity"]) and r["share_common"] < 0.3:
        return 1
    if r["dash"]:
        return 0 if r["starts_upper"] and r["ends_full_stop"] else 1 if not r["starts_upper"] and not r["ends_full_stop"] else -1
    if r["first_line"] and r["words"] >= 2 and r["letters"] > 0.7 and r["starts_upper"]:
        return 0
    if r["words"] >= 3 and r["letters"] > 0.65 and r["symbols"] < 0.15 and r["digits"] < 0.05 and (r["share_common"] >= 0.12 or r["starts_upper"] and r["document_common"] > 0.08):
        return 0
    return -1


#: Texts of every kind, which stand in for kinds that a sample lacks.
EXAMPLES: tuple[tuple[str, str], ...] = (
    ("prose", "The lamp had burned low by the time they came back from the harbour, and no one spoke of it.\nShe was not sure that he would have told them.\n“And what did you say to her?” he asked.\n“That it was late, and that you were not there.”"),
    ("prose", "When all the rivers of the north\nAre silver in the morning\nAnd every road that led us forth\nIs but a road of warning,\nThen we shall go to the sea"),
    ("prose", "– You have it with you?\n– I have not.\n– Then who has the other one?\n— They took it when they went out."),
    ("prose", "Der Weg war nicht so lang, wie sie es sich gedacht hatten, und auf dem Markt war noch Licht.\nEr sagte, dass es ihm nicht leid sei.\nWas haben sie mit dem Haus gemacht?"),
    ("prose", "Les enfants ne sont pas dans le jardin, et la porte de la maison est ouverte.\nIl y avait une lettre pour vous sur la table.\nC’est tout ce que je sais."),
    ("prose", "Он не был в городе, но они все это видели.\nКак и когда она пришла, никто не знал.\nЧто же мы будем делать?"),
    ("list", "• brown thread\n• two needles\n• lamp oil\n• a length of rope\n• salt"),
    ("list", "1. window frames\n2. door and hinges\n3. roof slates\n4. gutters"),
    ("list", "- candles and matches;\n- blankets;\n- lantern glass;\n- three tin cups;"),
    ("list", "harbour wall, 12, 48, 133\nherring, 7, 19\nhouses, painted, 201\nhymns, 64, 66"),
    ("list", "The Lighthouse ............ 3\nWinter Roads .............. 27\nA Letter .................. 61\nMorning ................... 94"),
    ("list", "Aldous, R. Tides and Lamps. 1931.\nBrenner, K. Die Brücke. 1954.\nCole, M. T. Notes on Rope. 1978."),
    ("list", "250 g flour\n2 eggs\n½ cup sugar\n3 × lemon peel"),
    ("table", "| year | boats | crew |\n| 1901 | 12 | 48 |\n| 1902 | 14 | 61 |\n| 1903 | 9 | 37 |"),
    ("table", "name\tweight\tshare\nA17\t12.5\t8%\nB04\t–\t11%\nB09\t7.75\t3%"),
    ("table", "month       rain       wind\nJan         44.1       NW\nFeb         39.0       W\nMar         51.3       NW"),
    ("table", "port;boats;crew;°C\nX1;12;40;±2\nX2;8;31;±1\nX3;–;12;±3"),
    ("table", "│  item  │  qty  │\n├────────┼───────┤\n│  rope  │  3    │\n│  lamp  │  12   │"),
    ("junk", "{}<>#$%^&*[]\\/|~{)(*&^\n$#@!%^&*()_+{}|<>\n~~/\\||[}{]#^^@!"),
    ("junk", ".c14 { margin: 0; }\nvar a7=f(12,'0ab3');\n.nav { float: left; }\nfunction(){return x;}"),
    ("junk", "<< prev || next >> [top] p.12\nnext >> || [top] << prev\n[top] [top] next >> p.13"),
    ("junk", "rn1|, ,l'm 0O~ . n.cv\n'lI1 r;n ,.m0 ~l|'\n;vn cI1 ,rm' 0.O|l ~n"),
    ("junk", "--------------------------------\n********************************\n................................\n================================"),
)


#: Lines of real chapters of the test tables, read and labelled by hand, beside the lines around them: the calibration holdout, never trained on.
HAND_CHECKED: tuple[tuple[str, str], ...] = (
    ("prose", "Not feather orcharding graveling so and Kralvilam thunderly they. “Harbourly the on who whispered sailoring th\nThundering façading was needlely bridged was kettles lettered up for for naïves gravelly thunders. Of cottagin"),
    ("prose", "Painter one cottage silence evening\nCoppering gardening needles ladder cottagely barrel cellared bridgely little bridging one of it of harbour sha"),
    ("prose", "Montanha por avião floresta escada\nO quando na mercadozinho riomente coraçãomente esse muito. De viagem porto de se escadazinho da que marinheiro"),
    ("prose", "Trädgård dröm brev dröm\nEn i år med, kopparar väg också har. “Ett andra här älv som det från stegen bara.” Koppar också upp skoghet om"),
    ("prose", "Duše můra přístav les\nHorový přístav jen jsou ve mlhami světlo si. Měďový věžami kůňy dušový řekami mlhový by to jen co dušový bouřk"),
    ("prose", "Ćma do mgła port\n— Jesieńami góry z…\n— Domy podróżami góry w jak do drabina.\n– Była przy dolina zamek."),
    ("list", "2 montañas cartito\n2 marinerito\n3 × sueñomente cobrito velamente canción"),
    ("list", "Hurnaekan, S. Valleys. 1988.\nNurnakun, G. Windowing naïvely windowly. 1931."),
    ("list", "Їжаки лісний гора свічки ........ 22\nОсіньи художникний сонний ..................... 274\nДжерели грози дуби ...................... 273"),
    ("list", "- cottaging;\n- eveninging thunders;\n- winter eveningly silence;"),
    ("list", "- castillos luz viajes;\n- cancións mañanamente;\n- luzs;"),
    ("list", "Sonhos ............ 276\nMãezinho sombras marinheirozinho .... 76\nÁrvores ........ 22"),
    ("table", "lumière     jardin      jardin      fenêtre     No.\nX37         4595        43%         ±2 °C       ±5 °C\nA86         46.62       62%         –           30.42"),
    ("table", "| ladder | kaars | brief |\n| C93 | 45.31 | 70% |\n| K76 | ±8 °C | 48.51 |"),
    ("table", "девушка;лестница;туман;дом;No.\nA59;–;17%;±2 °C;±3 °C\nC29;3473;±9 °C;–;–"),
    ("table", "│ thunder  │  winter  │ kitchen  │\n├──────────┼──────────┼──────────┤\n│   K18    │   4231   │   27%    │"),
    ("table", "fenêtre\tchêne\tâme\tchâteau\tNo.\tNo.\nK42\t±4 °C\t–\t73.61\t75.05\t–\nB82\t84%\t–\t–\t–\t±4 °C"),
    ("junk", "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~\n########################################\n**************"),
    ("junk", "uKXLrI15TgxBxjbHLkGPoDTrOnfdxgxMCKS0dqZRslrv3TTHmF0nQ7try/xOmwC3jsRi5Nr95YS3\n53bXwUOx/IUOPIxgDJutF3fYUrYxc0DXta5zbU714OoDg5/v+bkGH+xyCXG63Eef/KEIZzjoum8E"),
    ("junk", "%$%~\\#/^<<{!}(~#~)&@([}%>({\\]$)/)!//~!&*!~|]@{)[}>|\n!##{}%&[)@(~@!%|*@>$({#]%{[/\\|"),
    ("junk", "p.268 || >> ^top pg ^top >>\n[x] pg >> >>\n>> Nxt Nxt pg Nxt >> >>"),
    ("junk", "ffhgdd ww;;afwfllfje ;wl\n;h;sea dqsagj;ajk\n;dkwl qgw;hgka\nslghsfsfjgf;;d kglwfgwjlj; jwl;ew;khfajl sdjdd gfkwlhles"),
    ("junk", ".c898 { padding: 0; }\n.c25 { float: #a3f; }\n.c297 { padding: 12px; }"),
)


def labelled(texts: Iterable[tuple[str, str]], common: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and kinds of the lines of labelled texts."""
    xs, ys = [], []
    for kind, text in texts:
        lines = text.split("\n")
        xs.append(line_statistics(lines, common))
        ys += [KINDS.index(kind)] * len(lines)
    return np.vstack(xs), np.array(ys)


def calibration(trees: BoostedTrees, common: frozenset[str]) -> tuple[float, float, float]:
    """(share right, log loss, expected calibration error in ten bins) of hand-checked lines, each half judged by trees calibrated on the other half."""
    right, loss, error = [], [], []
    for k in (0, 1):
        x, y = labelled(HAND_CHECKED[k::2], common)
        trees.calibrate(*labelled(HAND_CHECKED[1 - k :: 2], common))
        p = trees.probabilities(x)
        right += (p.argmax(1) == y).tolist()
        loss += (-np.log(np.maximum(1e-12, p[np.arange(len(y)), y]))).tolist()
        error += p.max(1).tolist()
    trees.calibrate(*labelled(HAND_CHECKED, common))
    sure, right_ = np.array(error), np.array(right, float)
    bins = np.minimum(9, (sure * 10).astype(int))
    gap = sum(abs(right_[bins == b].mean() - sure[bins == b].mean()) * (bins == b).mean() for b in set(bins.tolist()))
    return float(right_.mean()), float(np.mean(loss)), float(gap)


def train(texts: Iterable[str], common: frozenset[str], lines: int = SAMPLE_LINES) -> BoostedTrees:
    """Trees trained on the weakly labelled lines of a bounded sample of texts, calibrated on the hand-checked ones."""
    xs, ys = [], []
    count = 0
    for text in texts:
        own = [s for s in mojibake.plain(text).split("\n") if s.strip()]
        x = line_statistics(own, common)
        y = [weak_label(s, r) for s, r in zip(own, x)]
        keep = [i for i, k in enumerate(y) if k >= 0]
        xs.append(x[keep])
        ys += [y[i] for i in keep]
        count += len(keep)
        if count >= lines:
            break
    if len(set(ys)) < len(KINDS):
        x, y = labelled(EXAMPLES, common)
        xs.append(x)
        ys += y.tolist()
    return BoostedTrees(len(KINDS)).fit(np.vstack(xs), np.array(ys)).calibrate(*labelled(HAND_CHECKED, common))


def sample_texts(frame: DataFrame, key: str, column: str, size: int = SAMPLE_CHAPTERS) -> list[str]:
    """At most ``size`` texts on the driver, chosen by the hash of their key (the key is hashed before any text moves)."""
    keys = frame.where(F.col(column).isNotNull()).select(F.xxhash64(F.col(key).cast("string")).alias("h")).distinct().orderBy("h").limit(size)
    last = keys.agg(F.max("h")).first()[0]
    if last is None:
        return []
    rows = frame.where(F.col(column).isNotNull() & (F.xxhash64(F.col(key).cast("string")) <= last)).select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(column).alias("t")).dropDuplicates(["h"])
    return [r.t for r in sorted(rows.collect(), key=lambda r: (r.h, r.t))]


def statistics(text: Column, trees: BoostedTrees, common: frozenset[str]) -> Column:
    """STRUCT of a text's statistics, the shares of its lines by kind, and the mean calibrated probabilities of the kinds."""

    @F.pandas_udf(
        "n_lines int, mean_word_length double, symbol_ratio double, share_punctuated double, share_common double, "
        "share_list double, share_table double, share_junk double, p_prose double, p_list double, p_table double, p_junk double"
    )
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            xs, sizes = [], []
            for text in batch:
                lines = [s for s in mojibake.plain(text or "").split("\n") if s and not s.isspace()]
                xs.append(line_statistics(lines, common))
                sizes.append(len(lines))
            x = np.vstack(xs) if xs else np.zeros((0, len(STATISTICS)))
            p = trees.probabilities(x)
            kind = p.argmax(1)
            out, at = [], 0
            for n in sizes:
                if not n:
                    out.append((0, *[0.0] * 7, 1.0, 0.0, 0.0, 0.0))
                    continue
                r, q, k = x[at : at + n], p[at : at + n], kind[at : at + n]
                size = np.expm1(r[:, 0])
                words = max(1.0, r[:, 1].sum())
                out.append((
                    n, float((r[:, _AT["mean_word"]] * np.maximum(1, r[:, 1])).sum() / words), float((r[:, 4] * size).sum() / size.sum()), float(r[:, _AT["ends_full_stop"]].mean()), float((r[:, _AT["share_common"]] * r[:, 1]).sum() / words),
                    *(float((k == i).mean()) for i in (1, 2, 3)), *map(float, q.mean(0)),
                ))
                at += n
            yield pd.DataFrame(out, columns=["n_lines", "mean_word_length", "symbol_ratio", "share_punctuated", "share_common", "share_list", "share_table", "share_junk", "p_prose", "p_list", "p_table", "p_junk"])

    return run(text)


def count_words(text: Column) -> Column:
    """Number of words separated by Unicode white space; runs in the JVM."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
