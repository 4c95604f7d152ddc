"""What grading needs of gzipped attestation bodies, read as a stream (the one Python UDF).

Kept in its own module without postponed annotations, so the pandas type
hints resolve when the UDF is declared."""

import gzip
import io
import zlib

import pandas as pd

HEAD_BYTES = 0x90  # the start of a report that holds its attested key
CHUNK = 1 << 20
FACTS = "head binary, size bigint, holds boolean"


def facts(body, key):
    """(first bytes, length, whether `key` occurs) of a gzipped body of any length; None if it can't
    be decoded to its end. One chunk and the last bytes of the one before are held at a time."""
    if body is None:
        return None
    head, size, holds, tail = b"", 0, False, b""
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(bytes(body))) as f:
            while chunk := f.read(CHUNK):
                head += chunk[:max(0, HEAD_BYTES - len(head))]
                size += len(chunk)
                if key and not holds:
                    holds = key in tail + chunk
                    tail = (tail + chunk)[-(len(key) - 1):] if len(key) > 1 else b""
    except (OSError, EOFError, zlib.error):
        return None   # undecodable body -> treated as absent
    return head, size, holds


def facts_series(body: pd.Series, key: pd.Series) -> pd.DataFrame:
    rows = [facts(b, None if k is None else bytes(k)) or (None, None, None) for b, k in zip(body, key)]
    return pd.DataFrame(rows, columns=["head", "size", "holds"], dtype=object)


def gunzip_facts_udf():
    """Declared on the driver when a plan needs it (executors only import the
    plain function)."""
    from pyspark.sql.functions import pandas_udf
    return pandas_udf(facts_series, FACTS)
