"""Language of texts: family first, then linear support vector machines within it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprobe.llm.common import draw_limit, fold, id_type, short_batches, texts

# Bound of the labelled rows per language that the machines are fitted on (expected).
ROWS_PER_LANGUAGE = 1_000
WIDTH = 4096
ROUNDS = 200
RIDGE = 1e-4
UNKNOWN = "und"
OTHER = "other"
# Languages by family; the codes are those of ISO 639-1.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indo-aryan": "bn gu hi mr ne or pa sa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg ms tl",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    """Hashed counts of the one- to three-byte strings of the text, damped, of norm 1."""
    raw = np.frombuffer(b" " + text.lower().encode().translate(_PLAIN) + b" ", np.uint8)
    one = raw.astype(np.uint32)
    two = one[:-1] * np.uint32(257) + one[1:]
    three = two[:-1] * np.uint32(263) + one[2:]
    counts = np.zeros(WIDTH)
    for grams, salt in ((one, 0x9E3779B1), (two, 0x85EBCA6B), (three, 0xC2B2AE35)):
        counts += np.bincount((grams * np.uint32(salt)) >> np.uint32(20), minlength=WIDTH)
    damped = np.log1p(counts)
    return damped / max(np.sqrt((damped**2).sum()), 1e-9)


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def fit(rows: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, classes balanced."""
    weight = np.where(sign > 0, 0.5 / (sign > 0).sum(), 0.5 / (sign < 0).sum()).astype(np.float32)
    data = np.hstack([rows, np.ones((len(rows), 1), np.float32)]).astype(np.float32)
    now = ahead = np.zeros(data.shape[1], np.float32)
    pace = 1.0
    for _ in range(ROUNDS):  # accelerated gradient; rows have norm 2 at most with the bias
        slack = np.maximum(0, 1 - sign * (data @ ahead))
        slope = RIDGE * ahead - 2 * data.T @ (weight * sign * slack)
        new = ahead - slope / 4
        later = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        now, ahead, pace = new, new + (pace - 1) / later * (new - now), later
    return now


def plan(languages: list[str]) -> list[tuple[str, str, str]]:
    """(group, first, second) of all machines: between families, then within each."""
    members: dict[str, list[str]] = {}
    for language in sorted(languages):
        members.setdefault(FAMILY.get(language, OTHER), []).append(language)
    between = [("", a, b) for a, b in combinations(sorted(members), 2)]
    within = [(f, a, b) for f, own in sorted(members.items()) for a, b in combinations(own, 2)]
    return between + within


def learn(docs: DataFrame, held_out_fold: int = 2, rows: int = ROWS_PER_LANGUAGE) -> dict:
    """Fit every machine in a task of its own, on a bounded sample of each language.

    Only texts and non-null ``lang`` of rows whose crc32 of the id modulo 4 is not
    ``held_out_fold`` take part. About ``rows`` of a language are drawn by a hash.
    """
    short_batches(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(
        F.coalesce(fold(4) != held_out_fold, F.lit(False))
    )
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(counts)
    machines = plan(languages)
    if not machines:
        return {"languages": languages, "machines": [], "weights": np.zeros((0, WIDTH + 1))}
    # the 63-bit number below which hashes of a language's ids have to lie
    limits = [F.lit(x) for lang, n in counts.items() for x in (lang, min(draw_limit(rows / n), 2**63 - 1))]
    bound = F.create_map(*limits)
    chosen = usable.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) <= bound[F.col("lang")])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, sign, rows = [], [], []
            for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True):
                row = features(text).astype(np.float16).tobytes()
                names = (FAMILY.get(lang, OTHER), lang)
                for n, (group, first, second) in enumerate(machines):
                    name = names[1] if group else names[0]
                    if name in (first, second) and (not group or group == names[0]):
                        number.append(n)
                        sign.append(1.0 if name == first else -1.0)
                        rows.append(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int32()), pa.array(sign, pa.float64()), pa.array(rows, pa.binary())],
                names=["machine", "sign", "row"],
            )

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        # the order of arrival depends on the cluster, the weights must not
        group = group.sort_values(["sign", "row"])
        data = np.frombuffer(b"".join(group["row"]), np.float16).reshape(-1, WIDTH)
        weights = fit(data.astype(np.float32), group["sign"].to_numpy(np.float32))
        return pd.DataFrame({"machine": group["machine"][:1], "weights": [weights.astype(np.float32).tobytes()]})

    measured = chosen.select("lang", "text").mapInArrow(measure, "machine int, sign double, row binary")
    grown = measured.groupBy("machine").applyInPandas(grow, "machine int, weights binary")
    weights = np.zeros((len(machines), WIDTH + 1), np.float32)
    for row in grown.collect():  # one per machine
        weights[row["machine"]] = np.frombuffer(row["weights"], np.float32)
    return {"languages": languages, "machines": machines, "weights": weights}


def decide(model: dict, rows: np.ndarray) -> list[tuple[str, float]]:
    """Language and score of each row of features.

    Among the families, then among the languages of the winner, the one with most wins
    is chosen, ties by summed margin. The score multiplies the logistic of the narrowest
    win of both steps.
    """
    margins = rows @ model["weights"][:, :-1].T + model["weights"][:, -1]

    def choose(group: str, names: list[str], own: np.ndarray) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        wins = dict.fromkeys(names, 0)
        sums = dict.fromkeys(names, 0.0)
        narrow = dict.fromkeys(names, np.inf)
        for (g, first, second), margin in zip(model["machines"], own.tolist(), strict=True):
            if g == group:
                wins[first if margin >= 0 else second] += 1
                for name, m in ((first, margin), (second, -margin)):
                    sums[name] += m
                    narrow[name] = min(narrow[name], m)
        best = max(names, key=lambda n: (wins[n], sums[n], n))
        return best, float(1 / (1 + np.exp(-3 * narrow[best])))

    members: dict[str, list[str]] = {}
    for language in model["languages"]:
        members.setdefault(FAMILY.get(language, OTHER), []).append(language)
    found = []
    for own in margins:
        family, sure = choose("", sorted(members), own)
        language, then = choose(family, members[family], own)
        found.append((language, sure * then))
    return found


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from the text alone.

    ``held_out`` tells whether crc32 of the id modulo 4 is 2. Null texts and texts
    without a letter are ``und`` with score 0, and so is every text if no language was
    learned. A null id is not held out; repeated rows get a row each; an empty table
    gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    short_batches(docs.sparkSession)
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            found = [(UNKNOWN, 0.0)] * batch.num_rows
            at, rows = [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                if own["languages"] and has_letter(text):
                    at.append(n)
                    rows.append(features(text).astype(np.float32))
            if rows:
                for n, answer in zip(at, decide(own, np.array(rows)), strict=True):
                    found[n] = answer
            columns = [
                batch.column("doc_id").cast(kind),
                batch.column("held_out"),
                pa.array([x for x, _ in found], pa.string()),
                pa.array([x for _, x in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "held_out", "lang_pred", "score"]
            )

    held = F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out")
    rows = texts(docs, held).select("doc_id", "held_out", "text")
    return rows.mapInArrow(
        run, f"doc_id {id_type(docs)}, held_out boolean, lang_pred string, score double"
    )
