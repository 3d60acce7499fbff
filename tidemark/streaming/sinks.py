"""Signed delivery of event batches."""

from __future__ import annotations

import hashlib
import hmac
import json
import time
from collections.abc import Callable, Iterator


def signature(secret: str, body: bytes) -> str:
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def batches(rows: Iterator, most: int = 100) -> Iterator[list]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held


#: Seconds before each further try of a batch; there are no more tries than these allow.
WAITS = (1, 5, 30)


def headers_of(body: bytes, items: int, secret: str, prefix: str = "X-") -> dict[str, str]:
    """What goes with a batch: its number of events, and its signature where there is a secret."""
    headers = {"Content-Type": "application/json", f"{prefix}Batch-Size": str(items)}
    return headers | ({f"{prefix}Signature": signature(secret, body)} if secret else {})


def signed_sink(post: Callable[[bytes, dict], int], secret: str = "", most: int = 100, retries: int = 3, waits: tuple = WAITS, prefix: str = "X-", sleep: Callable = time.sleep) -> Callable:
    """A ``foreachBatch`` function: rows of a micro-batch, in batches, each tried at most ``retries`` times more.

    ``post(body, headers)`` runs in the tasks and returns the HTTP status; a batch that is not taken fails
    the micro-batch, which is then delivered again, so nothing is dropped.
    """

    def send(partition: Iterator) -> None:
        for held in batches(partition, most):
            body = json.dumps([row.asDict(recursive=True) for row in held], default=str, separators=(",", ":")).encode()
            headers = headers_of(body, len(held), secret, prefix)
            for wait in (*waits[: max(0, retries)], None):
                if 200 <= post(body, headers) < 300:
                    break
                if wait is None:
                    raise RuntimeError("a batch was not taken")
                sleep(wait)

    return lambda frame, number: frame.foreachPartition(send)
