"""The binary form of records: a varint length, the selector's auxiliary hash, the fields in order."""

from __future__ import annotations

import datetime as dt
import ipaddress
import struct

from veilquery.schema import NULL_DEFAULTS, QuerySchema, field_type

_UTC = dt.timezone.utc


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


_FIXED = {"byte": ">b", "short": ">h", "float": ">f", "double": ">d"}


def encode_scalar(kind: str, v, size: int | None) -> bytes:
    if v is None and kind not in ("boolean", "ISO8601Date"):
        v = NULL_DEFAULTS[kind]
    if kind in _FIXED:
        return struct.pack(_FIXED[kind], v)
    if kind in ("int", "long"):
        return varint(v << 1 if v >= 0 else (-v << 1) - 1)
    if kind == "boolean":
        return struct.pack(">b", -1 if v is None else int(v))
    if kind == "char":
        return v.encode("utf-16-be")[:2]
    if kind in ("string", "byteArray"):
        body = v[:size].encode() if kind == "string" else bytes(v)[:size]
        return varint(len(body)) + body
    if kind in ("ip4", "ip6"):
        return ipaddress.ip_address(v).packed
    if v is None:
        raise ValueError("a date field is null")
    return struct.pack(">q", round(v.replace(tzinfo=v.tzinfo or _UTC).timestamp() * 1000))


def decode_scalar(kind: str, data: bytes, at: int):
    if kind in _FIXED:
        end = at + struct.calcsize(_FIXED[kind])
        return struct.unpack(_FIXED[kind], data[at:end])[0], end
    if kind in ("int", "long"):
        n, at = read_varint(data, at)
        return (n >> 1) ^ -(n & 1), at
    if kind == "boolean":
        return (None, False, True)[struct.unpack(">b", data[at : at + 1])[0] + 1], at + 1
    if kind == "char":
        return data[at : at + 2].decode("utf-16-be"), at + 2
    if kind in ("string", "byteArray"):
        n, at = read_varint(data, at)
        body = data[at : at + n]
        return (body.decode() if kind == "string" else body), at + n
    if kind in ("ip4", "ip6"):
        n = 4 if kind == "ip4" else 16
        return str(ipaddress.ip_address(data[at : at + n])), at + n
    return dt.datetime.fromtimestamp(struct.unpack(">q", data[at : at + 8])[0] / 1000, _UTC).replace(tzinfo=None), at + 8


def layout(schema: QuerySchema) -> list[tuple[str, str, bool, int | None, int | None]]:
    """name, scalar type, is list, size, most elements of the fields that a record carries (not the selector)."""
    return [(f.name, *field_type(schema.data[f.name].type), f.size, f.max_elements) for f in schema.fields if f.name != schema.selector]


def encode_record(fields: list, aux: int, values: list) -> bytes:
    out = [struct.pack(">i", aux)]
    for (_, kind, is_list, size, most), v in zip(fields, values, strict=True):
        if is_list:
            items = list(v if v is not None else [])[:most]
            out.append(varint(len(items)))
            out += [encode_scalar(kind, x, size) for x in items]
        else:
            out.append(encode_scalar(kind, v, size))
    body = b"".join(out)
    return varint(len(body)) + body


def decode_records(fields: list, aux: int, data: bytes):
    """The records with this auxiliary hash, in order; zero bytes between records are skipped."""
    at = 0
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        n, at = read_varint(data, at)
        # chunks of zeros are not sent, so the last record may end in zeros that are not there
        data += bytes(max(0, at + n - len(data)))
        end, own = at + n, struct.unpack(">i", data[at : at + 4])[0]
        if own == aux:
            place, values = at + 4, []
            for _, kind, is_list, _, _ in fields:
                if is_list:
                    count, place = read_varint(data, place)
                    items = []
                    for _ in range(count):
                        x, place = decode_scalar(kind, data, place)
                        items.append(x)
                    values.append(items)
                else:
                    x, place = decode_scalar(kind, data, place)
                    values.append(x)
            yield values
        at = end
