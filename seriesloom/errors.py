"""Errors of ingest and of the blob format. Reads of missing data never raise."""

from __future__ import annotations


class SeriesError(ValueError):
    """An error with a code from CODES."""

    def __init__(self, code: str, detail: str = ""):
        if code not in CODES:
            raise KeyError(code)
        self.code = code
        super().__init__(f"{code}: {CODES[code]}" + (f" ({detail})" if detail else ""))


#: Code and meaning.
CODES = {
    # protocol of a writer
    "MetricAlreadyStarted": "end the open metric before starting another",
    "NoMetricStarted": "start a metric before adding points",
    "MetricNotEnded": "a metric is still open",
    "NoMetricsAdded": "a blob needs at least one metric",
    "TooManyDataPoints": "more points than the metric claimed",
    "NoDataPointsAdded": "the metric has no points",
    "DataPointCountMismatch": "the number of points differs from the claim",
    "MixedIdentifierMode": "a blob is keyed either by ids or by names",
    # identity
    "InvalidMetricID": "a metric id must not be zero",
    "InvalidMetricName": "a metric name must not be empty or repeated",
    "HashCollision": "the metric id occurs twice in a blob",
    "HashMismatch": "a stored name does not hash to its id",
    "InvalidMetricNamesCount": "names and metrics differ in number",
    "InvalidMetricNamesPayload": "the names section is damaged",
    # limits
    "MetricCountExceeded": "more metrics than a blob may hold",
    "InvalidNumOfDataPoints": "the claimed number of points is out of range",
    "OffsetOutOfRange": "a metric's column is too long for the index",
    "BlobSizeExceedsLimit": "the blob is larger than its offsets can express",
    "DecompressedSizeExceedsLimit": "a section expands beyond the limit",
    "IndexEntryOverflow": "an index field is out of range",
    "HeaderOffsetOverflow": "a header offset is out of range",
    "ValueTooLong": "a text value or its tag is longer than 255 bytes",
    # format
    "InvalidMagicNumber": "not a blob",
    "InvalidHeaderSize": "the header is not whole",
    "InvalidHeaderFlags": "the header's flags are not valid",
    "InvalidMetricCount": "the metric count is out of range",
    "InvalidIndexEntrySize": "the index is not whole",
    "InvalidIndexOffsets": "index offsets must not decrease",
    "InvalidTimestampPayloadOffset": "the timestamp section is out of place",
    "InvalidValuePayloadOffset": "the value section is out of place",
    "InvalidTagPayloadOffset": "the tag section is out of place",
    "InvalidSharedTimestampTable": "the table of shared timestamps is damaged",
    "InvalidReservedBytes": "reserved bytes must be zero",
    "InvalidTimestampData": "a timestamp column is damaged",
    "InvalidValueData": "a value column is damaged",
    "InvalidALPScheme": "unknown ALP scheme",
    "InvalidALPColumn": "an ALP column is shorter than it says",
    "DataSizeMismatch": "a section has another size than the header says",
    "UnsupportedEncoding": "unsupported encoding",
    "UnsupportedCompression": "unsupported compression",
    # sets and input
    "EmptyBlobSet": "a typed set needs at least one blob",
    "InvalidInput": "the input does not follow its layout",
}
