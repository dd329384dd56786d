"""Detectors composed from what they have in common: who may call, who chooses a value, what becomes of a result, what happens after what."""

from __future__ import annotations

import yaml

# --- words -----------------------------------------------------------------------------------------------------------

CALLER, ARGUMENT = {"tainted": "user_controlled"}, {"tainted": "parameter"}


def node(kind: str, name: str | None = None, **more) -> dict:
    return {"block": kind} | ({"name": name} if name else {}) | more


def one_of(*rules: dict) -> dict:
    return {"any": list(rules)}


def word(*names: str) -> str:
    """A pattern for exactly these names."""
    return f"^{names[0]}$" if len(names) == 1 else "^(?:" + "|".join(sorted(names)) + ")$"


def without(rule: dict) -> dict:
    return {"not": rule}


def then(*steps: dict) -> dict:
    return {"sequence": list(steps)}


def runs_as(**traits: str) -> dict:
    """Of the function that all happens in."""
    return {"and": [traits]}


def arguments(*who: dict) -> dict:
    return {f"arg.{i}": w for i, w in enumerate(who)}


def target(who: dict) -> dict:
    """The thing that is called is the choice of ``who``."""
    return {"has": {"receiver": True} | who}


def operand(rule: dict) -> dict:
    return one_of({"left": rule}, {"right": rule})


#: Anyone gets here: nothing asks for a privileged caller, or for any particular one.
UNGUARDED, UNASKED, REENTERABLE = (without({"preset": p}) for p in ("access_controlled", "caller_checked", "reentrancy_guarded"))
#: A result that nothing takes up.
IGNORED = without({"in": one_of(*(node(b) for b in ("assign", "require", "assert", "if", "return")))})
#: Where a value decides what happens.
DECIDING = {"in": one_of(*(node(b) for b in ("if", "ternary", "require", "assert")))}
BALANCE_OF, BALANCE = node("external_call", word("balanceOf")), node("member", word("balance"))
TRUTH = node("literal", literal_kind="bool")
MESSAGE_VALUE = {"name": word("value"), "block": "member"}
PACKED = node("external_call", word("encodePacked"), **arguments(ARGUMENT, ARGUMENT))
DYNAMIC = r"(?:string|bytes|uint256\[\]|address\[\])\s+\w+"
PROXIES = ("Upgradeability", "AdminUpgradeability", "OwnedUpgradeability", "TransparentUpgradeable", "ERC1967")

DETECTORS: list[str] = []
PROBES: list[str] = []


def detector(name: str, severity: str, title: str, *where: dict, into: list[str] = DETECTORS, **query) -> None:
    if where:
        query["where"] = list(where)
    into.append(yaml.safe_dump({"id": name, "severity": severity, "title": title, "query": query}, sort_keys=False))


# --- calls to what the caller picks ----------------------------------------------------------------------------------

detector("delegatecall-user-input", "critical", "Delegatecall to an address the caller picks", UNGUARDED, target(CALLER), select="delegatecall")
detector("arbitrary-low-level-call", "high", "Target and data of a call are the caller's", UNGUARDED, target(CALLER), arguments(CALLER), select="lowlevel_call")
detector("arbitrary-transferfrom", "high", "Tokens of anyone who approved can be taken", UNASKED, node("external_call", word("transferFrom"), **arguments(ARGUMENT)), select="external_call")

# Ether that the caller himself sent along may go where he says.
_OWN_ETHER = {"has": MESSAGE_VALUE | {"call_option": "value", "left": node("identifier", word("msg"))}}
detector(
    "arbitrary-send-eth", "high", "Ether goes where the caller says", UNASKED,
    one_of(*({"has": node(b) | target(ARGUMENT)} for b in ("builtin_transfer", "builtin_send")), {"has": node("lowlevel_call", has_value=True) | target(ARGUMENT) | without(_OWN_ETHER)}),
)

# --- who may do it ---------------------------------------------------------------------------------------------------

detector("selfdestruct-unprotected", "critical", "Anyone can destroy the contract", UNGUARDED, select="selfdestruct")
detector("unrestricted-transferownership", "high", "Anyone can take ownership", UNGUARDED, {"func_name": word("transferOwnership")}, {"left": {"name": "(?i)owner"}, "right": CALLER}, select="state_write")
detector(
    "unprotected-initializer", "high", "Anyone can initialise", {"func_name": "(?i)" + word("initialize", "initialise", "init", "__init", "setup")}, UNGUARDED,
    without({"modifier": "(?i)(?:re)?initializer"}), without({"has": node("guard", has=node("identifier", word("_initializersDisabled")))}), {"has": node("state_write")},
)
detector("tx-origin-auth", "medium", "tx.origin as authority", {"name": r"tx\.origin"}, DECIDING, without({"regex": r"tx\.origin\s*==\s*msg\.sender|msg\.sender\s*==\s*tx\.origin"}), select="member", **{"from": "function"})

# --- what happens after what -----------------------------------------------------------------------------------------

detector("reentrancy-pattern", "high", "State changes after Ether left", REENTERABLE, then(one_of(node("delegatecall"), node("eth_transfer")), node("state_write")))
detector("reentrancy-balance", "high", "A balance is read on both sides of a call", REENTERABLE, then(BALANCE_OF, node("outgoing_call") | without({"name": word("balanceOf")}), one_of(BALANCE, BALANCE_OF)))
detector("ecdsa-recover-malleable", "high", "Malleable signature as a key", then(node("external_call", word("recover"), has={"receiver": True, "name": word("ECDSA")}), node("state_write", left=node("index", has=ARGUMENT))))
detector("delegatecall-in-loop", "high", "Payable delegatecall in a loop", runs_as(mutability="payable"), {"in": node("loop")}, select="delegatecall")
detector("msg-value-in-loop", "high", "The same Ether is counted in every round", runs_as(mutability="payable"), {"has": MESSAGE_VALUE | {"parent": word("msg")}}, select="loop")

# --- results nobody looks at -----------------------------------------------------------------------------------------

detector("unchecked-erc20-transfer", "high", "A token transfer's result is ignored", {"name": word("transfer", "transferFrom")}, IGNORED, select="external_call")
detector("unchecked-send", "medium", "A send's result is ignored", {"name": word("send")}, IGNORED, select="eth_transfer", **{"from": "function"})
detector("unchecked-lowlevel-call", "medium", "A call's result is ignored", IGNORED, select="lowlevel_call", **{"from": "function"})

# --- values that aren't what they seem -------------------------------------------------------------------------------

detector(
    "encode-packed-collision", "high", "Packed dynamic values can collide", runs_as(visibility="external,public", regex=rf"(?s)function\s+\w+\([^)]*{DYNAMIC}[^)]*{DYNAMIC}"),
    one_of({"has": node("internal_call", word("keccak256"), has=PACKED)}, then(PACKED, node("internal_call", word("keccak256"), **arguments(ARGUMENT)))), **{"from": "function"},
)
_PLAIN = one_of(node("identifier"), node("literal", literal_kind="number"))
detector(
    "incorrect-exp", "high", "Exclusive or where a power was meant", {"operator": r"\^"}, {"left": _PLAIN, "right": _PLAIN},
    without({"statement_has": one_of(node("binary", operator=r"&|\||<<|>>"), node("unary", operator="~"))}), select="binary", **{"from": "function"},
)
_MINED = r"(?i)^block\.(?:timestamp|number|difficulty|prevrandao|coinbase)$|^blockhash$"
detector("weak-prng", "high", "Chance from what miners set", {"operator": "%"}, {"has": node("member", _MINED)}, select="binary", **{"from": "function"})
detector("divide-before-multiply", "medium", "Precision is lost before it counts", {"operator": r"\*", "left": node("binary", operator="/")}, select="binary", **{"from": "function"})
detector("dangerous-strict-equality", "medium", "Equality on what others can change", {"operator": "==|!="}, one_of(*({"has": x} for x in (BALANCE, BALANCE_OF, node("member", word("number", "timestamp"))))), select="binary", **{"from": "function"})
detector("boolean-cst", "medium", "A constant decides", {"has": one_of(TRUTH | {"cond_role": "if|ternary"}, node("binary", operator=r"&&|\|\||==|!=") | operand(TRUTH))}, **{"from": "function"})
detector("unchecked-arithmetic", "medium", "Arithmetic may wrap", {"version": ">=0.8.0"}, runs_as(mutability="nonpayable,payable"), {"has": node("unchecked", has=node("binary", operator="[-+*/]", unchecked_var=True))}, **{"from": "function"})

# --- what should hold nothing ----------------------------------------------------------------------------------------

detector("view-pure-modifies-state", "medium", "A view that writes", runs_as(mutability="view,pure"), select="state_write", **{"from": "function"})
_FIXED = {"regex": r"\b(?:immutable|constant)\b"}
_STATE = node("variable", is_state_var=True)
detector("proxy-storage-collision", "high", "A proxy with state of its own", {"base": "(?:" + "|".join(f"{p}Proxy" for p in PROXIES) + ")"}, {"has": _STATE | without(_FIXED)}, {"has": {"regex": r"\bconstructor\s*\("}}, without({"has": _STATE | _FIXED}), **{"from": "contract"})

# --- probes ----------------------------------------------------------------------------------------------------------

detector("feature-args-taint", "high", "A parameter as the first argument", {"name": word("transferFrom")} | arguments(ARGUMENT), into=PROBES, select="external_call", **{"from": "function"})
detector("feature-eth-transfer", "low", "Ether leaves", into=PROBES, select="eth_transfer", **{"from": "function"})
detector("feature-inside", "medium", "tx.origin decides", {"name": r"tx\.origin"}, DECIDING, into=PROBES, select="member", **{"from": "function"})
detector("feature-sequence", "high", "State changes after a call", then(node("outgoing_call"), node("state_write")), into=PROBES)
detector("taint-probe-parameter", "info", "A parameter of an entry function as the first argument", {"name": word("transferFrom")} | arguments(ARGUMENT), into=PROBES, select="external_call", **{"from": "entry_function"})
