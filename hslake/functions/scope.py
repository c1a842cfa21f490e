"""Investigation scopes: a validated filter description compiled to one column."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Fixed values of the data model.
PARTIAL_STATES = ["client_hello_only", "server_hello_only", "retry_only", "ssh_identification", "ssh_kex_offers", "ssh_kex_selection", "ssh_no_common_algorithm", "wireguard_initiation", "ike_sa_offers", "openvpn_control", "openvpn_tls_client_hello"]
OPERATORS = ("contains", "equals", "starts_with", "not_equals", "observed", "not_observed")
HTTP_NAMES = ["HTTP", "HTTP/1.0", "HTTP/1.1"]
LAST_US = 253402300799999999


def server_name() -> Column:
    return F.coalesce(T.nonempty("sni"), T.json_value("crypto_json", "http_host"), F.col("destination_address"))


def connection_fields() -> dict[str, list[Column]]:
    """Each field with the columns that hold it."""
    c = F.col
    return {
        "Computer": [c("computer_name")], "Process": [c("source_process"), c("source_path"), c("destination_process")],
        "ClientProcess": [c("source_process"), c("source_path")], "ServerProcess": [c("destination_process")], "ServerName": [server_name()],
        "ClientAddress": [c("source_address")], "ServerAddress": [c("destination_address")], "ClientPort": [c("source_port")], "ServerPort": [c("destination_port")],
        "ProcessId": [c("source_pid"), c("destination_pid")], "Protocol": [c("tls_name")], "Transport": [F.coalesce(T.json_value("crypto_json", "transport"), F.lit("TCP"))],
        "Cipher": [c("cipher_name")], "Group": [c("group_name")], "State": [c("state")], "KeyClass": [T.json_value("crypto_json", "group_class")],
    }


def endpoint_fields() -> dict[str, list[Column]]:
    """The fields of endpoint events; client and server side follow the event's role."""
    c = F.col
    side = lambda role, value: F.when(c("local_role") == role, value)
    return {
        "Computer": [c("computer_name")], "Provider": [c("provider")], "ServerName": [c("peer")], "Protocol": [c("protocol")], "ServerPort": [c("port")],
        "ProcessId": [c("pid")], "ClientProcess": [side("Client", c("pid"))], "ServerProcess": [side("Server", c("pid"))], "State": [c("result")],
    }


def condition(columns: list[Column], operator: str, value: str = "") -> Column:
    if operator == "observed":
        return T.observed(columns)
    if operator == "not_observed":
        return ~T.observed(columns)
    if operator == "not_equals":
        return T.not_equals(columns, value)
    test = {"contains": T.contains, "equals": T.equals, "starts_with": T.starts_with}[operator]
    return T.any_of([test(c.cast("string"), value) for c in columns])


def hide_http(name: str = "tls_name") -> Column:
    return ~F.coalesce(F.col(name), F.lit("")).isin(HTTP_NAMES)


def hide_loopback() -> Column:
    def loop(name: str) -> Column:
        a = F.lower(name)
        return F.startswith(a, F.lit("127.")) | (a == "::1") | F.startswith(a, F.lit("::ffff:127."))

    return ~(T.any_of([loop("source_address"), loop("destination_address"), F.col("source_address") == F.col("destination_address")]))


#: The columns that one term searches, beside the accounts with their domains, four members of the record and the HTTP hosts.
SEARCHED = [
    "sni", "source_address", "destination_address", "source_process", "destination_process", "computer_name", "source_account", "source_account_domain", "source_account_sid", "destination_account",
    "destination_account_domain", "destination_account_sid", "group_name", "cipher_name", "tls_name", "key_exchange", "authentication", "psk_mode", "encryption", "alert", "certificate_sha256", "state",
]


def account(side: str) -> Column:
    """A side's account with its domain."""
    return F.concat(f"{side}_account_domain", F.lit("\\"), f"{side}_account")


def search_connections(term: str) -> Column:
    """One term over all text columns, the accounts with their domains, four members of the record and the HTTP hosts."""
    members = [F.coalesce(T.json_value("crypto_json", "transport"), F.lit("TCP")), *[T.json_value("crypto_json", p) for p in ("handshake_confirmation", "group_class", "http_host")]]
    return T.any_of([*[T.contains(F.col(c), term) for c in SEARCHED], *[T.contains(account(s), term) for s in ("source", "destination")], *[T.contains(m, term) for m in members], any_http_host(term)])


#: The columns of an event that one term searches, and the members of its metadata.
SEARCHED_EVENTS = ["peer", "provider", "kind", "result", "cipher", "protocol", "computer_name"]
SEARCHED_ASSESSMENT = ["process", "path", "server_name", "group_name", "crypto.group_class", "crypto.transport", "key_exchange", "authentication"]


def search_endpoints(term: str) -> Column:
    """One term over an event's text columns and its assessment."""
    return T.any_of([*[T.contains(F.col(c), term) for c in SEARCHED_EVENTS], *[T.contains(T.json_value("detail_json", f"assessment.{p}"), term) for p in SEARCHED_ASSESSMENT]])


def any_http_host(term: str, operator: str = "contains") -> Column:
    hosts = F.from_json(T.json_value("crypto_json", "http_hosts"), "array<string>")
    test = {"contains": T.contains, "equals": T.equals, "starts_with": T.starts_with}[operator]
    return F.coalesce(F.exists(hosts, lambda h: test(h, term)), F.lit(False))


@dataclass(frozen=True)
class Scope:
    """What to look at; conditions are (field, operator, value) and all must hold."""

    search: str = ""
    protocol: str = ""
    incomplete: bool = False
    from_us: int | None = None
    to_us: int | None = None
    since_minutes: int = 0
    page_size: int = 250
    conditions: tuple[tuple[str, str, str], ...] = field(default=())
    include_http: bool = True
    include_loopback: bool = True
    endpoints: bool = False

    def __post_init__(self):
        fields = endpoint_fields if self.endpoints else connection_fields
        assert len(self.conditions) <= 16 and len(self.search) <= 256, "a scope has 16 conditions and 256 characters at most"
        assert 50 <= self.page_size <= 2000, "a page has 50 to 2000 rows"
        for t in (self.from_us, self.to_us):
            assert t is None or 0 <= t <= LAST_US, "a time is out of range"
        assert None in (self.from_us, self.to_us) or self.from_us <= self.to_us, "a range ends before it begins"
        for name, op, value in self.conditions:
            assert op in OPERATORS and len(value) <= 256, f"unsupported condition {op}"
            assert name in _FIELD_NAMES[fields], f"unsupported field {name}"

    def column(self, now_us: int = LAST_US) -> Column:
        fields = endpoint_fields() if self.endpoints else connection_fields()
        time = F.col("timestamp_us" if self.endpoints else "first_us")
        tests = [condition(fields[n], op, v) for n, op, v in self.conditions]
        if self.from_us is not None or self.to_us is not None:
            tests.append(time.between(self.from_us or 0, self.to_us if self.to_us is not None else LAST_US))
        elif self.since_minutes:
            tests.append(time >= now_us - self.since_minutes * 60_000_000)
        if self.protocol:
            tests.append(F.col("protocol" if self.endpoints else "tls_name") == self.protocol)
        if self.incomplete:
            tests.append(F.lit(False) if self.endpoints else F.col("state").isin(PARTIAL_STATES))
        if not self.endpoints:
            tests += [hide_http()] * (not self.include_http) + [hide_loopback()] * (not self.include_loopback) + [search_connections(self.search)] * bool(self.search)
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out

    def key(self) -> str:
        """Equal for equivalent scopes: absolute dates count by their distance."""
        parts = asdict(self)
        if None not in (self.from_us, self.to_us):
            parts["window"] = self.to_us - self.from_us
        parts.pop("from_us"), parts.pop("to_us")
        return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Scope:
        raw = json.loads(text)
        unknown = set(raw) - set(cls.__dataclass_fields__)
        assert not unknown, f"unknown settings {sorted(unknown)}"
        raw["conditions"] = tuple(map(tuple, raw.get("conditions", ())))
        return cls(**raw)


_FIELD_NAMES = {
    connection_fields: "Computer Process ClientProcess ServerProcess ServerName ClientAddress ServerAddress ClientPort ServerPort ProcessId Protocol Transport Cipher Group State KeyClass".split(),
    endpoint_fields: "Computer Provider ServerName Protocol ServerPort ProcessId ClientProcess ServerProcess State".split(),
}
