"""Fixed values and schemas shared by every module."""

from pyspark.sql import types as T

# ---- fixed values -------------------------------------------------------------------------

# Backup types, in the order they appear in an object key.
SNAP, SST, CL, META = "SNAP", "SST", "CL", "META"

# Backup type -> (name used in metrics, whether the source may be removed once it is copied).
BACKUP_TYPES = {
    SNAP: ("snapshot", False),
    SST: ("incremental", True),
    CL: ("commitlog", False),
    META: ("metadata", False),
}

# Keyspace -> tables that are never backed up; None stands for the whole keyspace.
DENIED_TABLES = {
    "OpsCenter": None,
    "system": ["local", "peers", "LocationInfo"],
}

# Date format of snapshot names and of the time part of state names.
NAME_FORMAT = "yyyy-MM-dd-HH:mm:ss"

# Parts of an object key with and without keyspace and table.
FULL_KEY_PARTS, SHORT_KEY_PARTS = 8, 6

# Names in the service state.
SNAPSHOT_STATE = ("last_snapshot_name", "last_snapshot_status", "last_snapshot_filecount")
SST_STATE = ("last_sst_name", "last_sst_filecount")
CL_STATE = ("last_cl_name", "last_cl_filecount")

# Shown for a backup that never ran or whose time cannot be read.
NO_BACKUP, UNKNOWN_NUMBER = "(null)", -1

# Largest value of a single counter increment.
MAX_INCREMENT = 2147483647

# Upload attempts before giving up.
MAX_ATTEMPTS = 4

# Milliseconds between two progress lines of one file.
PROGRESS_INTERVAL_MS = 2000

# Rows in one file written by the bulk loader.
BULK_ROWS_PER_FILE = 150000

MB = 1024 * 1024

# Metrics reported for every table.
TABLE_METRICS = [
    "BloomFilterDiskSpaceUsed",
    "BloomFilterFalsePositives",
    "BloomFilterFalseRatio",
    "CompressionRatio",
    "EstimatedColumnCountHistogram",
    "EstimatedRowSizeHistogram",
    "KeyCacheHitRate",
    "LiveSSTableCount",
    "MaxRowSize",
    "MeanRowSize",
    "MemtableColumnsCount",
    "MemtableLiveDataSize",
    "MinRowSize",
    "RecentBloomFilterFalsePositives",
    "RecentBloomFilterFalseRatio",
    "SnapshotsSize",
    "LiveDiskSpaceUsed",
    "MemtableSwitchCount",
    "SpeculativeRetries",
    "TotalDiskSpaceUsed",
    "WriteTotalLatency",
    "ReadTotalLatency",
    "PendingFlushes",
    "ReadLatency",
    "CoordinatorReadLatency",
    "CoordinatorScanLatency",
    "WriteLatency",
    "LiveScannedHistogram",
    "SSTablesPerReadHistogram",
    "TombstoneScannedHistogram",
]

# ---- schemas ------------------------------------------------------------------------------

# Partition columns of a backup, always read back as text.
BACKUP_PARTITIONS = ["snapshot", "backup_type", "keyspace", "table"]


def with_partitions(schema: T.StructType, names: list[str]) -> T.StructType:
    """``schema`` plus text partition columns, so that a keyspace such as 007 stays text."""
    fields = [f for f in schema.fields if f.name not in names]
    return T.StructType(fields + [T.StructField(n, T.StringType()) for n in names])


MEMBERS = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("member", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("modified", T.LongType()),
        T.StructField("accepted", T.BooleanType()),
    ]
)

NODE_STATUS = T.StructType(
    [
        T.StructField("host_id", T.StringType()),
        T.StructField("rack", T.StringType()),
        T.StructField("dc", T.StringType()),
        T.StructField("live", T.BooleanType()),
        T.StructField("heap_usage", T.StringType()),
        T.StructField("heap_usage_perc", T.DoubleType()),
    ]
)
