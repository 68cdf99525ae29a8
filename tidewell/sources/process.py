"""Scores from an external program that reads a text a line and answers with a line each."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType


def by_lines(df: DataFrame, text: str, command: list[str], out: str = "answer", batch: int = 2000) -> DataFrame:
    """df with the program's answer to each text. Line breaks in a text become spaces and a null text an empty line. The program runs once for each batch; it must answer with as many lines as it got, or the job fails: answers are never shifted."""
    schema = StructType([*df.schema.fields, StructField(out, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), batch):
                b = whole.iloc[at : at + batch]
                lines = [" ".join((t or "").split()) for t in b[text]]
                done = subprocess.run(command, input="".join(f"{x}\n" for x in lines), capture_output=True, text=True, check=False)
                if done.returncode:
                    raise RuntimeError(f"{command[0]} ended with {done.returncode}: {done.stderr[-500:]}")
                answers = done.stdout.split("\n")
                answers = answers[:-1] if answers and answers[-1] == "" else answers
                if len(answers) != len(lines):
                    raise RuntimeError(f"{command[0]} answered {len(lines)} lines with {len(answers)}")
                yield b.assign(**{out: answers})

    return df.mapInPandas(run, schema)
