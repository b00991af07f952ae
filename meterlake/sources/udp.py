"""A stream of wire messages from UDP (R01, R02): ``spark.readStream.format("frames_udp")``.

Rows are (address, args array<string>, received_at, arrival_seq), which ``frames.parse_wire`` takes. A socket is one
machine's, so messages are read on the driver, at most ``max_messages`` a trigger; heavy traffic belongs into files or a
log that executors read.
"""

from __future__ import annotations

import socket
import struct
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "address string, args array<string>, received_at double, arrival_seq long"


def decode_osc(data: bytes) -> tuple[str, list[str]]:
    """Address and arguments of one OSC message; arguments as text. ValueError if it is none."""

    def text(at: int) -> tuple[str, int]:
        end = data.index(b"\0", at)
        return data[at:end].decode("utf-8", "replace"), (end // 4 + 1) * 4

    address, at = text(0)
    if not address.startswith("/"):
        raise ValueError("no OSC address")
    tags, at = text(at)
    if not tags.startswith(","):
        raise ValueError("no OSC type tags")
    args: list[str] = []
    for tag in tags[1:]:
        if tag in "ifhd":
            size = 8 if tag in "hd" else 4
            args.append(repr(struct.unpack_from(">" + {"i": "i", "f": "f", "h": "q", "d": "d"}[tag], data, at)[0]))
            at += size
        elif tag == "s":
            value, at = text(at)
            args.append(value)
        elif tag in "TF":
            args.append("1" if tag == "T" else "0")
        else:
            raise ValueError(f"OSC type {tag}")
    return address, args


def encode_osc(address: str, args: list[float | int | str]) -> bytes:
    """One OSC message of floats, ints and strings."""

    def text(s: str) -> bytes:
        raw = s.encode() + b"\0"
        return raw + b"\0" * (-len(raw) % 4)

    tags = "," + "".join("s" if isinstance(a, str) else "i" if isinstance(a, int) else "f" for a in args)
    return text(address) + text(tags) + b"".join(text(a) if isinstance(a, str) else struct.pack(">i" if isinstance(a, int) else ">f", a) for a in args)


def port_of(options: dict) -> int:
    port = int(options.get("port", 9855))
    if not 1 <= port <= 65535:
        raise ValueError(f"port {port} is not within 1..65535")
    return port


class UdpReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.limit = int(options.get("max_messages", 10_000))
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.bind((options.get("host", "127.0.0.1"), port_of(options)))
        self.socket.setblocking(False)
        self.kept: dict[int, tuple] = {}

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        seq = int(start["seq"])
        while seq - int(start["seq"]) < self.limit:
            try:
                address, args = decode_osc(self.socket.recv(65536))
            except BlockingIOError:
                break
            except (ValueError, struct.error):
                continue
            self.kept[seq] = (address, args, time.time(), seq)
            seq += 1
        return iter([self.kept[i] for i in range(int(start["seq"]), seq)]), {"seq": seq}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.kept[i] for i in range(int(start["seq"]), int(end["seq"])) if i in self.kept])

    def commit(self, end: dict) -> None:
        self.kept = {i: r for i, r in self.kept.items() if i >= int(end["seq"])}


class FramesUdp(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames_udp"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> UdpReader:
        return UdpReader(dict(self.options))
