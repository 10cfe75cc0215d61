"""Decoding of real-time feed messages from the protobuf wire format.

A message is a run of fields, each a key (number and wire type) and a value:
variable-length integers, 4 or 8 fixed bytes, or a length and as many bytes.
Fields that the tables below don't name are passed over, as the format asks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: Field numbers of the public real-time format. A name with "*"
#: repeats; kinds: int (signed), uint, text, float, or another message.
TEXT = {1: ("translation*", {1: ("text", "text"), 2: ("language", "text")})}
TRIP = {1: ("trip_id", "text"), 2: ("start_time", "text"), 3: ("start_date", "text"), 4: ("schedule_relationship", "int"), 5: ("route_id", "text"), 6: ("direction_id", "uint")}
CALL = {1: ("delay", "int"), 2: ("time", "int"), 3: ("uncertainty", "int")}
STOP_TIME = {1: ("stop_sequence", "uint"), 2: ("arrival", CALL), 3: ("departure", CALL), 4: ("stop_id", "text"), 5: ("schedule_relationship", "int")}
TRIP_UPDATE = {1: ("trip", TRIP), 2: ("stop_time_update*", STOP_TIME), 4: ("timestamp", "uint"), 5: ("delay", "int")}
POSITION = {1: ("latitude", "float"), 2: ("longitude", "float"), 3: ("bearing", "float"), 5: ("speed", "float")}
VEHICLE = {1: ("trip", TRIP), 2: ("position", POSITION), 3: ("current_stop_sequence", "uint"), 4: ("current_status", "int"), 5: ("timestamp", "uint"), 7: ("stop_id", "text")}
PERIOD = {1: ("start", "uint"), 2: ("end", "uint")}
SELECTOR = {1: ("agency_id", "text"), 2: ("route_id", "text"), 3: ("route_type", "int"), 4: ("trip", TRIP), 5: ("stop_id", "text")}
ALERT = {1: ("active_period*", PERIOD), 5: ("informed_entity*", SELECTOR), 6: ("cause", "int"), 7: ("effect", "int"), 8: ("url", TEXT), 10: ("header_text", TEXT), 11: ("description_text", TEXT), 14: ("severity_level", "int")}
ENTITY = {1: ("id", "text"), 2: ("is_deleted", "uint"), 3: ("trip_update", TRIP_UPDATE), 4: ("vehicle", VEHICLE), 5: ("alert", ALERT)}
FEED = {2: ("entity*", ENTITY)}


def varint(raw: bytes, at: int) -> tuple[int, int]:
    """(value, where it ends)."""
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("a variable-length integer has too many bytes")


def fields(raw: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of each field."""
    at = 0
    while at < len(raw):
        key, at = varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(raw, at)
        elif kind in (1, 2, 5):
            size, at = varint(raw, at) if kind == 2 else (8 if kind == 1 else 4, at)
            value, at = raw[at : at + size], at + size
            if at > len(raw):
                raise ValueError("a field is cut off")
        else:
            raise ValueError(f"wire type {kind} is not in use")
        yield key >> 3, kind, value


def decode(raw: bytes, known: dict[int, tuple]) -> dict:
    """The known fields of a message, by name."""
    out: dict = {}
    for number, kind, value in fields(raw):
        name, shape = known.get(number, ("", ""))
        if not name:
            continue
        if isinstance(shape, dict):
            value = decode(value, shape)
        elif shape == "text":
            value = value.decode("utf-8", "replace")
        elif shape == "float":
            value = struct.unpack("<f", value)[0]
        elif shape == "int":
            value = value - (1 << 64) if value >= 1 << 63 else value
        if name.endswith("*"):
            out.setdefault(name[:-1], []).append(value)
        else:
            out[name] = value
    return out


def messages(raw: bytes) -> list[dict]:
    """The entities of a feed message; translated texts are their lists."""
    found = decode(raw, FEED).get("entity", [])
    for entity in found:
        alert = entity.get("alert", {})
        for name in ("url", "header_text", "description_text"):
            if name in alert:
                alert[name] = alert[name].get("translation", [])
    return found
