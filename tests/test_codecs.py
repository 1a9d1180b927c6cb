"""Codecs round-trip, and no bytes make a decoder do anything but refuse."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import keys as K
from tidemark.sources import segment as G

U64 = st.integers(0, 2**64 - 1)
VALUES = st.one_of(st.tuples(st.none(), st.none()), st.tuples(st.binary(max_size=40), st.none()), st.tuples(st.none(), st.tuples(st.text(max_size=10), U64, st.integers(0, 2**32 - 1))))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(max_size=12), st.tuples(U64, st.one_of(st.none(), U64), VALUES), min_size=1, max_size=8), U64, U64, U64)
def test_segments_round_trip(rows, keyspace, partition, epoch):
    records = [G.Record(k, lamport, expires, value, external) for k, (lamport, expires, (value, external)) in sorted(rows.items())]
    assert G.decode(G.encode(records, keyspace, partition, epoch)) == (keyspace, partition, records)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300))
def test_arbitrary_bytes_are_refused(data):
    for read in (G.decode, lambda d: G.decode_record(d, 0)):
        try:
            read(data)
        except G.Corrupt:
            pass


@given(st.binary(max_size=20), st.binary(max_size=20), st.binary(max_size=20))
def test_cursors_round_trip(prefix, key, route):
    assert K.decode_cursor(prefix, K.encode_cursor(prefix, key)) == key
    assert K.decode_route(K.encode_route(K.encode_cursor(prefix, key), route)) == (K.encode_cursor(prefix, key), route)


@given(st.binary(max_size=6), st.binary(max_size=8))
def test_prefix_bound_is_exact(prefix, key):
    upper = K.prefix_upper_bound(prefix)
    assert key.startswith(prefix) == (key >= prefix and (upper is None or key < upper))
