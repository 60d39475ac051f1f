"""The reference's nine authorisation / model-route cases and four AP
contract / proposal cases, as rows with the expected decision."""

from ledgershield.operators import authz as AZ

PRINCIPAL = "subject string, principal_tenant string, verified boolean, permissions array<string>, tenant_id string"
ROUTE = (PRINCIPAL + ", data_class string, requested_model string, classification_complete boolean, "
         "redaction_complete boolean")
POLICY = ("tenant_id string, allowed_external_models array<string>, allowed_external_classes array<string>, "
          "private_model string, external_egress_enabled boolean")


def test_authorize_cases(spark):
    rows = [
        ("unverified", "alpha", False, ["model:invoke"], "alpha"),
        ("cross", "alpha", True, ["model:invoke"], "beta"),
        ("noperm", "alpha", True, [], "alpha"),
        ("ok", "alpha", True, ["model:invoke"], "alpha"),
        ("badtenant", "-alpha", True, ["model:invoke"], "-alpha"),
    ]
    out = {r.subject: r.deny_reason for r in AZ.authorize(spark.createDataFrame(rows, PRINCIPAL)).collect()}
    assert out == {"unverified": "unverified principal", "cross": "cross-tenant access",
                   "noperm": "permission denied", "ok": None, "badtenant": "invalid tenant"}


def test_model_route_cases(spark):
    p = ["model:invoke"]
    rows = [
        # private model allowed even though redaction is incomplete (default policy)
        ("private_ok", "alpha", True, p, "alpha", "restricted", "sealed", True, False),
        # external model under the default policy: denied
        ("ext_default", "alpha", True, p, "alpha", "public", "gpt", True, True),
        # configured tenant: incomplete redaction, class not listed, all satisfied
        ("ext_redaction", "beta", True, p, "beta", "public", "gpt", True, False),
        ("ext_class", "beta", True, p, "beta", "restricted", "gpt", True, True),
        ("ext_ok", "beta", True, p, "beta", "public", "gpt", True, True),
        # classification incomplete fails closed even for the private model
        ("no_class", "alpha", True, p, "alpha", "public", "sealed", False, True),
    ]
    pol = spark.createDataFrame([("beta", ["gpt"], ["public"], "sealed", True)], POLICY)
    out = {r.subject: (r.allowed, r.model, r.deny_reason)
           for r in AZ.model_route(spark.createDataFrame(rows, ROUTE), pol).collect()}
    assert out["private_ok"] == (True, "sealed", None)
    assert out["ext_default"][0] is False
    assert out["ext_redaction"] == (False, None, "redaction incomplete")
    assert out["ext_class"] == (False, None, "data class not approved for external processing")
    assert out["ext_ok"] == (True, "gpt", None)
    assert out["no_class"] == (False, None, "classification incomplete")


CONTRACT = ("agent_id string, version string, tenant_id string, allowed_actions array<string>, "
            "supervisor string, may_approve boolean, may_release_payment boolean")
PROPOSAL = ("proposal_id string, agent_id string, tenant_id string, invoice_id string, action string, "
            "amount_raw string, currency string, evidence_id string, idempotency_key string")


def test_contract_and_proposal_cases(spark):
    contracts = spark.createDataFrame([
        ("ap-worker", "1", "alpha", ["payment.propose"], "sup", False, False),
        ("ap-releaser", "1", "alpha", [], "sup", False, True),
    ], CONTRACT)
    c = {r.agent_id: r.valid for r in AZ.check_contracts(contracts).collect()}
    assert c == {"ap-worker": True, "ap-releaser": False}
    props = spark.createDataFrame([
        ("valid", "ap-worker", "alpha", "inv1", "payment.propose", "120.00", "GBP", "e1", "k1"),
        ("cross", "ap-worker", "beta", "inv1", "payment.propose", "120.00", "GBP", "e1", "k1"),
        ("nan", "ap-worker", "alpha", "inv1", "payment.propose", "NaN", "GBP", "e1", "k1"),
        ("zero", "ap-worker", "alpha", "inv1", "payment.propose", "0", "GBP", "e1", "k1"),
        ("neg", "ap-worker", "alpha", "inv1", "payment.propose", "-1", "GBP", "e1", "k1"),
        ("ccy", "ap-worker", "alpha", "inv1", "payment.propose", "1", "gbp", "e1", "k1"),
        ("noev", "ap-worker", "alpha", "inv1", "payment.propose", "1", "GBP", "", "k1"),
    ], PROPOSAL)
    out = {r.proposal_id: r.reason for r in AZ.check_proposals(props, contracts).collect()}
    assert out["valid"] is None and out["zero"] is None
    assert out["cross"] == "cross-tenant AP proposal"
    assert out["nan"] == "invalid amount" and out["neg"] == "invalid amount"
    assert out["ccy"] == "invalid currency"
    assert out["noev"] is not None
