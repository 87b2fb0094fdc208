"""The flow-table contract: column names, label taxonomy and projection checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: names of the public CICIoT2023 flow table, in their fixed order ---

LABEL = "label"

FEATURES = [
    "flow_duration",
    "Header_Length",
    "Protocol Type",
    "Duration",
    "Rate",
    "Srate",
    "Drate",
    "fin_flag_number",
    "syn_flag_number",
    "rst_flag_number",
    "psh_flag_number",
    "ack_flag_number",
    "ack_count",
    "syn_count",
    "fin_count",
    "urg_count",
    "rst_count",
    "HTTP",
    "HTTPS",
    "DNS",
    "SSH",
    "TCP",
    "UDP",
    "ARP",
    "ICMP",
    "IPv",
    "LLC",
    "Tot sum",
    "Min",
    "Max",
    "AVG",
    "Std",
    "Tot size",
    "IAT",
    "Number",
    "Magnitue",
    "Radius",
    "Covariance",
    "Variance",
    "Weight",
]

EXCLUDED = ["ece_flag_number", "cwr_flag_number", "Telnet", "SMTP", "IRC", "DHCP"]

BENIGN_CLASS = "BenignTraffic"
ABSTAIN_LABEL = "UNCERTAIN_RARE"
UNCERTAINTY_FLOOR = 0.50

# label -> family, in label order
TAXONOMY = {
    "BenignTraffic": "Benign",
    "Backdoor_Malware": "Malware",
    "BrowserHijacking": "WebAttack",
    "CommandInjection": "WebAttack",
    "DDoS-ACK_Fragmentation": "DDoS",
    "DDoS-HTTP_Flood": "DDoS",
    "DDoS-ICMP_Flood": "DDoS",
    "DDoS-ICMP_Fragmentation": "DDoS",
    "DDoS-PSHACK_Flood": "DDoS",
    "DDoS-RSTFINFlood": "DDoS",
    "DDoS-SYN_Flood": "DDoS",
    "DDoS-SlowLoris": "DDoS",
    "DDoS-SynonymousIP_Flood": "DDoS",
    "DDoS-TCP_Flood": "DDoS",
    "DDoS-UDP_Flood": "DDoS",
    "DDoS-UDP_Fragmentation": "DDoS",
    "DNS_Spoofing": "Spoofing",
    "DictionaryBruteForce": "BruteForce",
    "DoS-HTTP_Flood": "DoS",
    "DoS-SYN_Flood": "DoS",
    "DoS-TCP_Flood": "DoS",
    "DoS-UDP_Flood": "DoS",
    "MITM-ArpSpoofing": "Spoofing",
    "Mirai-greeth_flood": "Mirai",
    "Mirai-greip_flood": "Mirai",
    "Mirai-udpplain": "Mirai",
    "Recon-HostDiscovery": "Recon",
    "Recon-OSScan": "Recon",
    "Recon-PingSweep": "Recon",
    "Recon-PortScan": "Recon",
    "SqlInjection": "WebAttack",
    "Uploading_Attack": "WebAttack",
    "VulnerabilityScan": "Recon",
    "XSS": "WebAttack",
}

# --- End of fixed values ---


def flow_schema(features: Sequence[str] = FEATURES, label: str | None = LABEL) -> T.StructType:
    """All features as doubles, then the nullable string label (left out when ``label`` is None)."""
    fields = [T.StructField(name, T.DoubleType()) for name in features]
    if label is not None:
        fields.append(T.StructField(label, T.StringType()))
    return T.StructType(fields)


def ticked(name: str) -> str:
    """A column name for SQL text, also when it holds spaces or dots."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    """A column by its literal name."""
    return F.col(ticked(name))


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def require_label(df: DataFrame, label: str = LABEL) -> None:
    if label not in df.columns:
        raise ValueError(f"Label column '{label}' not found")


def conform(
    df: DataFrame,
    features: Sequence[str] = FEATURES,
    *,
    label: str | None = None,
    carry: Sequence[str] = (),
    dtype: str = "double",
) -> DataFrame:
    """Project to ``carry``, the features in order, and the label when one is named.

    Missing features raise with their names; every other column is pruned at the scan. Strings are
    cast with ``try_cast``, so a malformed number becomes null rather than ending the job.
    """
    require_columns(df, features)
    if label is not None:
        require_label(df, label)
    types = dict(df.dtypes)
    columns = [ticked(name) for name in carry]
    for name in features:
        cast = "TRY_CAST" if types[name] == "string" else "CAST"
        plain = types[name] == dtype
        columns.append(ticked(name) if plain else f"{cast}({ticked(name)} AS {dtype}) AS {ticked(name)}")
    if label is not None:
        columns.append(ticked(label))
    return df.selectExpr(*columns)


def labelled(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows whose label is known."""
    require_label(df, label)
    return df.where(quoted(label).isNotNull())
