"""An experiment as JSON files: two engagements of one tenant, with what each check is to fold to, and a runner's manifest."""

import json

CHECKS = {"check-login-sqli": ("sql_injection", "sig-login-sqli", "/login"), "check-search-xss": ("xss", "sig-search-xss", "/search"), "check-admin-authz": ("broken_authz", "sig-admin-authz", "/admin"), "check-upload-rce": ("rce", "sig-upload-rce", "/upload"), "check-api-ssrf": ("ssrf", "sig-api-ssrf", "/api/data"), "check-report-idor": ("idor", "sig-report-idor", "/report")}
TARGET = {"cluster_id": "cluster-prod", "resource_kind": "Deployment", "resource_uid": "deploy-web"}


class Stream:
    """The events of one engagement, in order of their positions."""

    def __init__(self, n, day):
        self.n, self.day, self.events = n, day, []

    def add(self, name, kind, payload):
        place = len(self.events) + 1
        at = f"{self.day}T09:{place - 1:02d}:00Z"
        self.events.append({"source_event_id": f"e{self.n}-{name}", "event_type": kind, "source_stream_id": f"stream-e{self.n}", "source_sequence": place, "schema_version": 1, "occurred_at": at, "payload": payload})

    def check(self, key):
        context = {"protocol": "https", "port": 443, "normalized_route": CHECKS[key][2], "is_address_bound": False}
        return TARGET | {"verification_key": key, "check_version": "1.0.0", "relevant_context": context, "compatibility_policy_version": 1}

    def finding(self, name, key):
        self.add(name, "finding_observation", self.check(key) | {"vuln_class": CHECKS[key][0], "normalized_location_signature": CHECKS[key][1]})

    def attempt(self, name, key, status, result=None):
        self.add(name, "test_attempt", self.check(key) | {"execution_status": status} | ({"result": result} if result else {}))

    def asset(self, name, **signals):
        self.add(name, "asset_observation", {"cluster_id": "cluster-prod", "resource_kind": "Deployment"} | signals)

    def marker(self):
        self.add("marker", "engagement_completed", {"last_data_sequence": len(self.events)})


def experiment():
    one, two, dns = Stream(1, "2026-03-01"), Stream(2, "2026-06-01"), "web.prod.svc.cluster.local"
    one.asset("asset", resource_uid="deploy-web", pod_uid="pod-e1", pod_name="web-6d8f-e1", ip_address="10.1.0.5", dns=dns)
    for name, key in zip(("still", "fixed", "regress", "untested", "incon"), CHECKS):
        one.finding(name, key)
    one.attempt("regress-neg", "check-admin-authz", "completed", "not_detected")
    one.marker()
    two.asset("asset", resource_uid="deploy-web", pod_uid="pod-e2", pod_name="web-7a2c-e2", ip_address="10.2.0.9", dns=dns)
    two.finding("still", "check-login-sqli")
    two.attempt("still-detect", "check-login-sqli", "completed", "detected")
    two.attempt("fixed-neg", "check-search-xss", "completed", "not_detected")
    two.finding("regress", "check-admin-authz")
    two.attempt("regress-detect", "check-admin-authz", "completed", "detected")
    two.attempt("incon-partial", "check-api-ssrf", "partial")
    two.finding("new", "check-report-idor")
    two.asset("weak", pod_name="web-orphan-1", dns=dns)
    two.marker()
    return one.events, two.events


def event_set(events, n, tenant="tenant-acme"):
    return json.dumps({"trusted_context": {"tenant_id": tenant, "engagement_id": f"engagement-{n}"}, "events": events})


def write(folder):
    """One file for each engagement, and the manifest."""
    one, two = experiment()
    (folder / "sets").mkdir()
    (folder / "sets/e1.json").write_text(event_set(one, 1))
    (folder / "sets/e2.json").write_text(event_set(two, 2))
    actions = {"T-A": ("check-login-sqli", ["e2-still", "e2-still-detect"]), "T-B": ("check-search-xss", ["e2-fixed-neg"]), "T-C": ("check-admin-authz", ["e2-regress", "e2-regress-detect"])}
    candidates = [{"candidate_id": c, "scenario_label": "F-ANY", "target": TARGET, "verification_key": k, "action_event_ids": a, "frozen_outcome": {"execution_status": "completed", "result": "detected"}} for c, (k, a) in actions.items()]
    (folder / "manifest.json").write_text(json.dumps({"action_budget": 3, "candidates": candidates, "background": [{"event_id": e, "scenario_label": "F-ANY"} for e in ("e2-incon-partial", "e2-new")]}))
