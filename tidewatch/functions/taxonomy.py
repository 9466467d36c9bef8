"""Label taxonomy: leaf label -> family -> class index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.ordering import bounded_table

# The class order (benign is index 0) and the leaves of each family.
CLASS_NAMES = (
    "Benign", "DDoS", "DoS", "Mirai", "Reconnaissance", "Spoofing", "BruteForce", "WebBased",
)
FAMILY_LEAVES = {
    "Benign": ["BenignTraffic"],
    "DDoS": [
        "DDoS-ACK_Fragmentation", "DDoS-HTTP_Flood", "DDoS-ICMP_Flood",
        "DDoS-ICMP_Fragmentation", "DDoS-PSHACK_Flood", "DDoS-RSTFINFlood", "DDoS-SYN_Flood",
        "DDoS-SlowLoris", "DDoS-SynonymousIP_Flood", "DDoS-TCP_Flood", "DDoS-UDP_Flood",
        "DDoS-UDP_Fragmentation",
    ],
    "DoS": ["DoS-HTTP_Flood", "DoS-SYN_Flood", "DoS-TCP_Flood", "DoS-UDP_Flood"],
    "Mirai": ["Mirai-greeth_flood", "Mirai-greip_flood", "Mirai-udpplain"],
    "Reconnaissance": [
        "Recon-HostDiscovery", "Recon-OSScan", "Recon-PingSweep", "Recon-PortScan",
        "VulnerabilityScan",
    ],
    "Spoofing": ["DNS_Spoofing", "MITM-ArpSpoofing"],
    "BruteForce": ["DictionaryBruteForce"],
    "WebBased": [
        "Backdoor_Malware", "BrowserHijacking", "CommandInjection", "SqlInjection",
        "Uploading_Attack", "XSS",
    ],
}

BENIGN_INDEX = 0


def taxonomy_rows() -> list[tuple[str, str, int]]:
    return [
        (leaf, family, CLASS_NAMES.index(family))
        for family in CLASS_NAMES
        for leaf in FAMILY_LEAVES[family]
    ]


def taxonomy_table(spark: SparkSession) -> DataFrame:
    """The fixed (leaf, family, class_index) dimension of 34 rows."""
    return spark.createDataFrame(
        taxonomy_rows(), "leaf string, family string, class_index int"
    )


def with_family(
    df: DataFrame, label: str, taxonomy: DataFrame | None = None, max_leaves: int = 10_000
) -> DataFrame:
    """Add ``family`` and ``class_index``; a label outside the taxonomy fails the job.

    A given taxonomy is broadcast up to ``max_leaves`` rows and joined by shuffle beyond.
    """
    table = F.broadcast(taxonomy_table(df.sparkSession)) if taxonomy is None else bounded_table(
        taxonomy.select("leaf", "family", "class_index"), max_leaves
    )
    joined = df.join(table, df[label].cast("string") == table["leaf"], "left").drop("leaf")
    unknown = F.raise_error(
        F.concat(F.lit("label not in the taxonomy: "), F.coalesce(F.col(label), F.lit("null")))
    )
    return joined.withColumns(
        {
            "family": F.coalesce("family", unknown.cast("string")),
            "class_index": F.coalesce("class_index", unknown.cast("int")),
        }
    )
