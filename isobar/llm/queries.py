"""All training-data queries and their SQL."""

from isobar.llm import (  # noqa: F401
    bpe,
    chat,
    decontaminate,
    html,
    language,
    licenses,
    manifest,
    neardup,
    quality,
    resample,
    substrings,
    urls,
    vectors,
)
from isobar.llm.common import QUERIES, SQL  # noqa: F401
