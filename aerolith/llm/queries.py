"""All queries of the subpackage and their SQL."""

from aerolith.llm import (  # noqa: F401
    bpe, centroids, chat, html_blocks, mih, mixing, phrases, prefix_counts, quality, secret_scan, simhash, url_model, wavelet,
)
from aerolith.llm.registry import ORACLES, QUERIES  # noqa: F401
