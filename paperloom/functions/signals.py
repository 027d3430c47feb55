"""Expressions over decoded media: loudness windows, pixels, frames; the tone of text by a lexicon."""

from __future__ import annotations

import base64
import hashlib
import hmac
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.runs import islands


def decibels(rms: Column) -> Column:
    return F.when(rms > 0, 20 * F.log10(rms)).otherwise(F.lit(-120.0))


def window_class(loudness: Column, low_energy: Column, crossing_spread: Column) -> Column:
    """silence below -50 dB; speech where quiet parts and crossings vary; noise where crossings do; else music."""
    return F.when(loudness < -50, "silence").when((low_energy > 0.3) & (crossing_spread > 0.15), "speech").when(crossing_spread > 0.15, "noise").otherwise("music")


def speech_baseline(windows: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """The upper median loudness of speech windows; only of `least` and more."""
    rows = windows.where("label = 'speech'").groupBy(*keys).agg(F.sort_array(F.collect_list("loudness")).alias("l"))
    return rows.where(F.size("l") >= least).select(*keys, F.element_at("l", (F.floor(F.size("l") / 2) + 1).cast("int")).alias("baseline"))


def sound_events(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Windows (`i`, `label`, `confidence`, `start`, `end`) as events: one empty window is bridged, short events are dropped."""
    runs = islands(windows, [*keys, "label"], "i").groupBy(*keys, "label", "island").agg(F.min("start").alias("start_seconds"), F.max("end").alias("end_seconds"), F.max("confidence").alias("confidence"))
    least = F.when(F.col("label") == "silence", 3).when(F.col("label").isin("speech", "music", "noise"), 2).otherwise(1)
    return runs.where(F.col("end_seconds") - F.col("start_seconds") >= least).drop("island")


def _linear(c: Column) -> Column:
    x = c / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def oklab(r: Column, g: Column, b: Column) -> list[Column]:
    """sRGB (0 to 255) in Oklab."""
    r, g, b = _linear(r), _linear(g), _linear(b)
    cone = [F.cbrt(a * r + c * g + d * b) for a, c, d in ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))]
    return [a * cone[0] + c * cone[1] + d * cone[2] for a, c, d in ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))]


def dominant_colours(pixels: DataFrame, key: str, palette: dict[str, tuple[int, int, int]], least: float = 0.05, most: int = 5) -> DataFrame:
    """Of pixels (`r`, `g`, `b`): the nearest palette colour of each, by share; at most five of a twentieth and more."""
    from pyspark.sql import Window

    own = oklab(F.col("r"), F.col("g"), F.col("b"))
    near = F.array_min(F.array(*(F.struct(sum((a - b) * (a - b) for a, b in zip(own, oklab(*map(F.lit, rgb)))).alias("d"), F.lit(name).alias("name")) for name, rgb in palette.items())))
    counts = pixels.select(key, near["name"].alias("colour")).groupBy(key, "colour").agg(F.count("*").alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("share"), "colour"))
    return shares.where(F.col("share") >= least).withColumn("rank", rank).where(F.col("rank") <= most).drop("n")


def difference_hash(luma: Column) -> Column:
    """A 64-bit fingerprint of 8 rows of 9 grey values: whether each is darker than the next."""
    bits = F.flatten(F.transform(luma, lambda row: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.element_at(row, i) < F.element_at(row, i + 1)).cast("long"))))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit))


def webhook_signature(secret: str, msg_id: str, timestamp: int, body: str) -> str:
    """HMAC-SHA256 over 'id.timestamp.body', as 'v1,' and base64; a secret with the prefix whsec_ is base64 itself."""
    key = base64.b64decode(secret[6:]) if secret.startswith("whsec_") else secret.encode()
    return "v1," + base64.b64encode(hmac.new(key, f"{msg_id}.{timestamp}.{body}".encode(), hashlib.sha256).digest()).decode()


#: Words that turn a valence around, words that raise or lower it, and phrases with a valence of their own.
NEGATIONS = frozenset(
    "aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't mightn't mustn't neednt needn't never none nope nor not nothing nowhere oughtnt "
    "shant shouldnt uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't wouldn't rarely seldom despite".split()
)
RAISES = frozenset(
    "absolutely amazingly awfully completely considerable considerably decidedly deeply effing enormous enormously entirely especially exceptional exceptionally extreme extremely fabulously flipping flippin frackin fracking fricking frickin frigging friggin fully fuckin fucking fuggin fugging greatly hella highly hugely "
    "incredible incredibly intensely major majorly more most particularly purely quite really remarkably so substantially thoroughly total totally tremendous tremendously uber unbelievably unusually utter utterly very".split()
)
LOWERS = frozenset(["almost", "barely", "hardly", "just enough", "kind of", "kinda", "kindof", "kind-of", "less", "little", "marginal", "marginally", "occasional", "occasionally", "partly", "scarce", "scarcely", "slight", "slightly", "somewhat", "sort of", "sorta", "sortof", "sort-of"])
PHRASES = {"the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5, "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9}
STEP, CAPITALS, TURN = 0.293, 0.733, -0.74
_FADE = (1.0, 0.95, 0.9)
_ENDS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _tone_words(text: str) -> list[str]:
    """Words without the marks around them; what would be two characters or less stays whole, as it may be a face."""
    return [bare if len(bare) > 2 else word for word in text.split() for bare in (word.strip(_ENDS),)]


def _step(word: str) -> float:
    return STEP if word in RAISES else -STEP if word in LOWERS else 0.0


class _Tone:
    """The words of a text and what they do to each other."""

    def __init__(self, words: list[str], lexicon: dict[str, float]) -> None:
        self.words, self.low, self.lexicon = words, [w.lower() for w in words], lexicon
        loud = [w.isupper() for w in words]
        self.mixed = any(loud) and not all(loud)

    def turned(self, at: int, back: int) -> float:
        """What the word `back` places before does to a valence, beside its step: a factor."""
        low, word = self.low, self.low[at - back]
        between = low[at - back + 1 : at]
        if back > 1 and ((word == "never" and between[0] in ("so", "this")) or (back == 3 and between[-1] in ("so", "this"))):
            return 1.25
        if back > 1 and word == "without" and "doubt" in between:
            return 1.0
        return TURN if word in NEGATIONS or "n't" in word else 1.0

    def phrased(self, at: int, value: float) -> float:
        """The valence of a word that is part of a phrase, or follows one."""
        part = lambda a, b: " ".join(self.low[at + a : at + b])
        before = (part(-1, 1), part(-2, 1), part(-2, 0), part(-3, 0), part(-3, -1))
        value = next((PHRASES[p] for p in before if p in PHRASES), value)
        for size in (2, 3):
            if at + size <= len(self.low):
                value = PHRASES.get(part(0, size), value)
        return value + sum(map(_step, (part(-3, 0), part(-3, -1), part(-2, 0))))

    def value(self, at: int) -> float:
        low, base = self.low, self.lexicon.get(self.low[at])
        after = low[at + 1] if at + 1 < len(low) else ""
        if base is None or _step(low[at]) or (low[at] == "kind" and after == "of"):
            return 0.0
        value = 0.0 if low[at] == "no" and after in self.lexicon else base
        if "no" in low[max(0, at - 2) : at] or (at > 2 and low[at - 3] == "no" and low[at - 1] in ("or", "nor")):
            value = base * TURN
        if self.mixed and self.words[at].isupper():
            value += CAPITALS if value > 0 else -CAPITALS
        for back, fade in zip((1, 2, 3), _FADE):
            if at < back or low[at - back] in self.lexicon:
                continue
            step = _step(low[at - back])
            if step:
                step = -step if value < 0 else step
                if self.mixed and self.words[at - back].isupper():
                    step += CAPITALS if value > 0 else -CAPITALS
            value = (value + step * fade) * self.turned(at, back)
            if back == 3:
                value = self.phrased(at, value)
        least = at and low[at - 1] == "least" and "least" not in self.lexicon and (at == 1 or low[at - 2] not in ("at", "very"))
        return value * TURN if least else value


def tone_score(text: str, lexicon: dict[str, float]) -> float:
    """Compound tone in [-1, 1]: word valences of a lexicon, stepped or turned by the three words before, weighed around 'but', with emphasis."""
    tone = _Tone(_tone_words(text), lexicon)
    scores = [tone.value(k) for k in range(len(tone.low))]
    if "but" in tone.low:
        at = tone.low.index("but")
        scores = [s * (0.5 if k < at else 1.5 if k > at else 1.0) for k, s in enumerate(scores)]
    total, asks = sum(scores), text.count("?")
    emphasis = min(text.count("!"), 4) * 0.292 + (0.0 if asks < 2 else asks * 0.18 if asks <= 3 else 0.96)
    total += math.copysign(emphasis, total) if total else 0.0
    return max(-1.0, min(1.0, total / math.sqrt(total * total + 15)))


def tone_scores(text: Column, lexicon: dict[str, float]) -> Column:
    """`tone_score` of a column; null for null."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else tone_score(t, lexicon)), "double")(text)


def tone_label(score: Column) -> Column:
    return F.when(score >= 0.05, "positive").when(score <= -0.05, "negative").otherwise("neutral")


def redacted(text: Column, folders: list[str]) -> Column:
    """Known folders out of messages, the longest first."""
    for folder in sorted(folders, key=len, reverse=True):
        text = F.regexp_replace(text, re.escape(folder.rstrip("/")) + r"(?=/|\b|$)", "<dir>")
    return text
