"""Fixed dimension tables of the dialect experiments, at most a few dozen rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Class order of the dialect classifier, with the country code and
# the macro group of each class.
DIALECT_CLASSES = [
    ("Algeria", "dza", "Maghreb"),
    ("Bahrain", "bhr", "Gulf"),
    ("Egypt", "egy", "Nile"),
    ("Iraq", "irq", "Gulf"),
    ("Jordan", "jor", "Levant"),
    ("Kuwait", "kwt", "Gulf"),
    ("Lebanon", "lbn", "Levant"),
    ("Libya", "lby", "Maghreb"),
    ("Morocco", "mar", "Maghreb"),
    ("Oman", "omn", "Gulf"),
    ("Palestine", "pse", "Levant"),
    ("Qatar", "qat", "Gulf"),
    ("Saudi_Arabia", "sau", "Gulf"),
    ("Sudan", "sdn", "Nile"),
    ("Syria", "syr", "Levant"),
    ("Tunisia", "tun", "Maghreb"),
    ("UAE", "are", "Gulf"),
    ("Yemen", "yem", "Aden"),
]

# Language codes accepted per target language.
ALLOWED_CODES = {
    "ara": ["ara", "arb", "arq", "arz", "acm", "ayp", "apc", "ajp", "afb",
            "ayl", "ary", "acw", "ars", "apd", "aeb", "ayn", "acq"],
    "eng": ["eng"],
}

# Corpora, dialects and languages of the reports.
FIDELITY_CORPORA = {"mono": ["madar", "habibi", "flores-dev"], "cross": ["hehe", "okapi", "sharegpt"]}
REPORT_DIALECTS = ["egy", "mar", "pse", "sau", "syr"]
MT_CORPORA = ["madar", "flores"]
PIVOT_LANGUAGES = ["eng", "msa"]
DIALECTS8 = ["dza", "mar", "egy", "sdn", "pse", "syr", "sau", "kwt"]
DIALECTS4 = ["dza", "egy", "syr", "sau"]


def directions(dialects: list[str]) -> list[str]:
    """Both ways between each pivot language and each dialect."""
    out = [f"{pivot}-{dialect}" for pivot in PIVOT_LANGUAGES for dialect in dialects]
    return out + [f"{dialect}-{pivot}" for pivot in PIVOT_LANGUAGES for dialect in dialects]


# Which languages or directions each task covers.
TASK_TARGETS = {
    "monolingual": DIALECTS8,
    "crosslingual": DIALECTS8,
    "mt": directions(DIALECTS4),
}


def class_dim(spark: SparkSession) -> DataFrame:
    """18 rows: class index, names, and which classes share the macro group."""
    rows = [
        (idx, dialect, country, macro, [other == macro for _, _, other in DIALECT_CLASSES])
        for idx, (dialect, country, macro) in enumerate(DIALECT_CLASSES)
    ]
    return spark.createDataFrame(
        rows, "class_idx int, dialect_name string, country string, macro string, same_macro array<boolean>"
    )


def allowed_dim(spark: SparkSession, allowed: dict[str, list[str]] = ALLOWED_CODES) -> DataFrame:
    rows = [(target, code) for target, codes in allowed.items() for code in codes]
    return spark.createDataFrame(rows, "target_lang string, code string")


def fidelity_grid(spark: SparkSession) -> DataFrame:
    """Every (set, corpus, dialect) a fidelity report must show."""
    rows = [
        (name, corpus, dialect)
        for name, corpora in FIDELITY_CORPORA.items() for corpus in corpora for dialect in REPORT_DIALECTS
    ]
    return spark.createDataFrame(rows, "lang_set string, corpus string, dialect string")


def mt_grid(spark: SparkSession) -> DataFrame:
    """Every (corpus, direction) a translation report must show."""
    rows = [(corpus, d) for corpus in MT_CORPORA for d in directions(REPORT_DIALECTS)]
    return spark.createDataFrame(rows, "corpus string, direction string")


def task_grid(spark: SparkSession) -> DataFrame:
    """Every (task, target) of the experiments."""
    rows = [(task, target) for task, targets in TASK_TARGETS.items() for target in targets]
    return spark.createDataFrame(rows, "task string, target string")
