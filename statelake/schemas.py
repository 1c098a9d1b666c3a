"""Explicit schemas; nothing in the package infers one."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _B, _L, _I = T.StringType(), T.BinaryType(), T.LongType(), T.IntegerType()

STATE = _struct(type=_S, address=_B, key=_B, value=_B, tx_hash=_B, blob_index=_L, position=_L, timestamp=_L)
STATE_COLUMNS = STATE.names

# state plus the columns K2 derives; Spark would read them back as int without a schema
STATE_PARTITIONED = T.StructType(STATE.fields + _struct(chain_id=_L, date=_I, topic=_S).fields)

STORAGE_DIFFS = _struct(address=_S, key=_S, value=_S, src=_S)
DECLARED_CLASSES = _struct(class_hash=_S, compiled_class_hash=_S, src=_S)
DEPLOYED_OR_REPLACED = _struct(address=_S, class_hash=_S, src=_S)
NONCES = _struct(contract_address=_S, nonce=_S, src=_S)

DIFF_TABLES = {
    "storage_diffs": STORAGE_DIFFS,
    "declared_classes": DECLARED_CLASSES,
    "deployed_or_replaced": DEPLOYED_OR_REPLACED,
    "nonces": NONCES,
}

WALLET_MAP = _struct(class_hash=_S, wallet=_S)
INDEX_MAP = _struct(idx=_S, val=_S)
FILE_LEDGER = _struct(name=_S, sha1=_S, written=_L)
BLOB_REPORT = _struct(path=_S, ok=T.BooleanType(), rows=_L, seconds=T.DoubleType(), error=_S)

# one decoded state-diff document
DIFF_DOCUMENT = _struct(
    storage_diffs=T.ArrayType(_struct(address=_S, storage_entries=T.ArrayType(_struct(key=_S, value=_S)))),
    declared_classes=T.ArrayType(_struct(class_hash=_S, compiled_class_hash=_S)),
    deployed_or_replaced=T.ArrayType(_struct(address=_S, class_hash=_S)),
    nonces=T.ArrayType(_struct(contract_address=_S, nonce=_S)),
)

# one parsed contract list; a storage pair is an object or a two-element list, so it stays JSON text here
CONTRACTS_DOCUMENT = _struct(
    contracts=T.ArrayType(_struct(address=_S, class_hash=_S, nonce=_S, storage=T.ArrayType(_S)))
)
STORAGE_PAIR = _struct(key=_S, value=_S)

_REFS = T.ArrayType(_struct(url=_S))
BLOB_ITEM = _struct(
    eth_block_number=_L, blockNumber=_L, tx_hash=_S, txHash=_S, index=_L,
    timestamp=T.DoubleType(), blockTimestamp=_S, time=_S,
    dataStorageReferences=_REFS, data_storage_references=_REFS, storage=_struct(url=_S), storageUrl=_S,
)

# file catalogue: `ord` gives the place inside a kind
CATALOG = _struct(kind=_S, path=_S, ord=_L)
SEGMENTS = _struct(file=_S, path=_S, url=_S, ord=_L)
