"""Stop-word lists: Spark ML's built-in lists (shipped inside the MLlib jar).

Read straight from the jar, so they are available to plan builders and SQL
twins without a running JVM; ``StopWordsRemover.loadDefaultStopWords`` is the
fallback.  Each list has a few hundred words — a proven bound that makes the
``(lang, word)`` table safe to broadcast.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

# ISO code -> Spark list name for the supported languages.
LANGUAGES = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}
UNKNOWN = "unknown"


@functools.lru_cache(maxsize=None)
def stop_words(lang: str) -> tuple[str, ...]:
    name = LANGUAGES.get(lang, lang)
    import pyspark

    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    for jar in jars:
        with zipfile.ZipFile(jar) as zf:
            entry = f"org/apache/spark/ml/feature/stopwords/{name}.txt"
            if entry in zf.namelist():
                words = zf.read(entry).decode("utf-8").split("\n")
                return tuple(dict.fromkeys(w.strip() for w in words if w.strip()))
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords(name))


def stop_word_rows(languages=tuple(LANGUAGES)) -> list[tuple[str, str]]:
    return [(lang, w) for lang in languages for w in stop_words(lang)]


def stop_word_sql(languages=tuple(LANGUAGES)) -> str:
    """The same table as a SQL ``VALUES`` list (for the SQL twins)."""
    rows = ", ".join("('{}', '{}')".format(lang, w.replace("'", "''")) for lang, w in stop_word_rows(languages))
    return f"(VALUES {rows}) AS sw(lang, word)"
