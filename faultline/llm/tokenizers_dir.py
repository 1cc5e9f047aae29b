"""Where the files of public tokenizers lie."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTING = "spark.faultline.tokenizers.dir"


def tokenizer_file(spark: SparkSession, name: str) -> str:
    """The path of a tokenizer's file, which every executor must be able to open.

    The folder is the session's ``spark.faultline.tokenizers.dir``; without that
    setting it is the folder of the installed package ``public_tokenizers``.
    Raises ``RuntimeError`` where there is neither.
    """
    folder = spark.conf.get(SETTING, None)
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers
    except ImportError:
        raise RuntimeError(f"set {SETTING} to a folder with {name} that all executors can open") from None
    return public_tokenizers.path(name)
