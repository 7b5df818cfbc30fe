"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroid_clusters, decontaminate, jaccard_join, license_scan, quality_rules, suffix_dedup, tensor_minhash, vector_codes
from .centroid_clusters import op12_centroid_clusters
from .decontaminate import op6_decontamination
from .jaccard_join import op5_jaccard_join
from .language_id import op3_language_id
from .license_scan import op1_license_scan
from .quality_rules import op9_quality_rules
from .secret_scan import op10_secret_scan
from .sentencepiece_codec import op2_sentencepiece
from .suffix_dedup import op8_suffix_dedup
from .tensor_minhash import op13_minhash_dedup
from .toxicity import op7_toxicity
from .url_filter import op4_url_filter
from .vector_codes import op11_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_language_id": op3_language_id,
    "op4_url_filter": op4_url_filter,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scan": op10_secret_scan,
    "op11_vector_codes": op11_vector_codes,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_minhash_dedup": op13_minhash_dedup,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op6_decontamination": decontaminate.SQL,
    "op8_suffix_dedup": suffix_dedup.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_centroid_clusters": centroid_clusters.SQL,
    "op13_minhash_dedup": tensor_minhash.SQL,
}
