"""Sinks: the processed table, and reports as CSV or LaTeX."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexeum import schema


def output_name(translate: bool = False, assign_splits: bool = False) -> str:
    return "_".join(["unified", *["translated"] * translate, *["with_splits"] * assign_splits]) + ".parquet"


def save(df: DataFrame, folder: str, translate: bool = False, assign_splits: bool = False) -> str:
    """Check the columns, then write; columns that translation added are left out."""
    out = schema.check_columns(df.drop(*schema.TRANSLATION_COLUMNS))
    path = f"{folder.rstrip('/')}/{output_name(translate, assign_splits)}"
    out.write.mode("overwrite").parquet(path)
    return path


def save_report(df: DataFrame, path: str) -> str:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


_LATEX = str.maketrans({c: f"\\{c}" for c in "&%$#_{}"} | {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"})


def latex_table(df: DataFrame, digits: int = 4) -> str:
    """A small result as a LaTeX table, its rows in their order; missing values are dashes."""
    say = lambda v: "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).translate(_LATEX)
    lines = [" & ".join(map(say, r)) + r" \\" for r in [tuple(df.columns), *df.collect()]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule", lines[0], r"\midrule", *lines[1:], r"\bottomrule", r"\end{tabular}"])


def save_latex(df: DataFrame, path: str, digits: int = 4) -> str:
    """The LaTeX table as one text file."""
    df.sparkSession.createDataFrame([(latex_table(df, digits),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path
