"""Small tables with everything that may go wrong."""

import functools
import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, word string, rid long, hood long, part int, level int, marks string, size long, c long, block long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A-Z to a-z, and nothing else.
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(t):
    return (t or "").translate(LOW)


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


def rows(n=60, seed=5):
    return list(_rows(n, seed))


@functools.cache
def _rows(n, seed):
    """Texts of four vocabularies, with nulls, blanks, repeats, odd spaces and one long text; the other columns' names clash on purpose."""
    rng = random.Random(seed)
    stems = {"en": ["the", "of", "thing", "Other", "wood"], "de": ["der", "und", "Straße", "über", "Haus"], "fr": ["le", "été", "dans", "çà", "eau"], "es": ["el", "niño", "por", "ción", "agua"]}
    out = []
    for i in range(n):
        lang = list(stems)[i % 4]
        words = [rng.choice(stems[lang]) + (rng.choice(stems[lang]) if rng.random() < 0.4 else "") for _ in range(rng.randint(60, 160))]
        text = " ".join(w + (".\n" if k % 11 == 10 else "") for k, w in enumerate(words))
        out.append([i, text, lang, f"s{i % 3}"])
    out[3][1], out[4][1], out[5][1], out[6][1] = None, "", " \t\n\x0b ", "x"
    out[7][1] = "123 456 !!! ###"
    out[8][1] = out[9][1] = out[10][1]  # copies
    out[11][1] = out[10][1] + " one more word"
    out[12][1] = "a b   c\x1cd Eİ 𝒳𝒴 \x85"
    out[13][1] = " ".join(rng.choice(stems["en"]) + str(rng.randint(0, 999)) for _ in range(30_000))
    out[14][1] = "w" * 20_000
    out[15][2] = out[15][3] = None
    out.append([17, out[17][1], out[17][2], out[17][3]])  # a row twice
    out.append([None, out[18][1], "en", None])
    return [(*r, len(r[1] or ""), 0.5, True, "w", 1, 2, 3, 4, "m", 5, 6, 7) for r in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def documents(spark, path, data=None):
    """A folder with documents.parquet, as queries read it."""
    frame(spark, data).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)
