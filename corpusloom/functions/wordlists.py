"""Public word lists that are part of every Spark distribution: the stop words of its ML library."""

from __future__ import annotations

import glob
import os
import zipfile
from functools import lru_cache

# Names of the lists by language code.
LISTS = {"en": "english", "pt": "portuguese", "es": "spanish", "fr": "french", "it": "italian", "de": "german"}
# Negations, which turn the meaning and are never stop words.
NEGATIONS = frozenset(["no", "nor", "not", "never", "none", "cannot", "não", "nem", "nunca", "jamais", "sem", "without"])


@lru_cache(None)
def function_words(language: str) -> tuple[str, ...]:
    """The list of a language in its own order."""
    import pyspark

    homes = [os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)]
    for jar in (j for h in homes if h for j in sorted(glob.glob(os.path.join(h, "jars", "spark-mllib_*.jar")))):
        with zipfile.ZipFile(jar) as z:
            raw = z.read(f"org/apache/spark/ml/feature/stopwords/{LISTS[language]}.txt").decode("utf-8")
            return tuple(dict.fromkeys(w for line in raw.splitlines() if (w := line.strip().lower())))
    raise FileNotFoundError("no spark-mllib library among Spark's jars")


@lru_cache(None)
def stop_list(language: str) -> tuple[str, ...]:
    """Function words of two letters or more that negate nothing, sorted.

    "no" is a contraction in Portuguese and a negation in English; it stays out of both lists.
    """
    return tuple(sorted(w for w in function_words(language) if len(w) > 1 and w not in NEGATIONS and not w.endswith(("n't", "n’t"))))
