"""The one-pass scan against the relational engine, on a project with libraries, inheritance, imports and every matcher of the language."""

import pytest

from gritstone.plans import extract
from gritstone.solidity import codedb
from gritstone.sources import project
from gritstone.wql import rules
from gritstone.wql.evaluate import Engine
from gritstone.wql.scan import scan

FILES = {
    "foundry.toml": "[profile.default]\nremappings = ['@lib/=vendor/lib/']\n",
    "src/Vault.sol": """pragma solidity ^0.8.19;
import {Base, Other as Renamed} from "./Base.sol";
import "@lib/Maths.sol";
import "./missing.sol";
contract Vault is Base, Renamed {
    using Maths for uint256;
    using Kept for *;
    uint256 public total; mapping(address => uint256) shares; address keeper; bool open;
    constructor(uint256 a) Base(a) Renamed() { total = a; }
    modifier onlyKeeper() { require(msg.sender == keeper, "keeper"); _; }
    function hook() public override(Base, Renamed) { super.hook(); total = total.plus(1); }
    function pay(address payable to, uint256 n) external onlyKeeper { to.transfer(n); shares[to] -= n; }
    function take(address to, uint256 n) external { (bool ok, ) = to.call{value: n, gas: 5000}(""); require(ok); _book(to, Maths.twice(n)); }
    function _book(address to, uint256 n) internal { if (n > 10) { shares[to] = n; } else { total = n; } unchecked { total = total - n; } }
    function either(uint256 n) external returns (uint256 r) { if (n == 0) { r = block.timestamp; } else { total = n; } try this.view_() returns (uint256 v) { r = v; } catch { open = false; } }
    function view_() external view returns (uint256) { return open ? total : shares[msg.sender]; }
    function loop(address[] calldata who) external payable { for (uint256 i = 0; i < who.length; i++) { who[i].delegatecall(abi.encodeWithSignature("f(uint256)", msg.value)); } }
    function low() external { assembly { let x := sload(0) sstore(1, add(x, 1)) } selfdestruct(payable(msg.sender)); }
    function deep(uint256 n) external { _a(n); _a(n); } function _a(uint256 n) internal { _b(n); _b(n); } function _b(uint256 n) internal { _c(n); _c(total); } function _c(uint256 n) internal { total = n; keeper = tx.origin; }
}
""",
    "src/Base.sol": """pragma solidity >=0.8.0;
interface Hooked { function hook() external; }
abstract contract Root { function hook() public virtual { emit Rung(1); } event Rung(uint256 n); }
contract Base is Root { uint256 held; constructor(uint256 a) { held = a; } function hook() public virtual override { held += 1; super.hook(); } }
contract Other is Root { uint256 other; constructor() { other = 2; } function hook() public virtual override { other = 3; super.hook(); } }
/* é ☃ */ contract Söl { string name = "ü"; function f(string memory a, bytes memory b) public returns (bytes32) { return keccak256(abi.encodePacked(a, b)); } }
""",
    "vendor/lib/Maths.sol": """library Maths { using Kept for uint256; function plus(uint256 a, uint256 b) internal pure returns (uint256) { return a.keep() + b; } function twice(uint256 a) internal pure returns (uint256) { return a * 2 / 3 * 4; } }
library Kept { function keep(uint256 a) internal pure returns (uint256) { require(a < 2 ** 128); return a; } }
""",
    "test/Skipped.sol": "contract Skipped { }",
    "node_modules/x/Far.sol": "contract Far { this is not parsed",
}

TEMPLATES = """
{from: function, select: call}
{from: entry_function, select: state_write}
{select: state_write, where: [{not: {preset: access_controlled}}, {right: {tainted: user_controlled}}]}
{from: function, select: outgoing_call, where: [{in: {block: loop}}]}
{from: function, where: [{has: {block: require}}, {not: {has: {block: selfdestruct}}}]}
{from: function, select: identifier, where: [{name: '^(total|held)$'}, {statement_has: {block: literal}}]}
{from: function, select: binary, where: [{operator: '-|\\+'}, {left: {block: identifier}}]}
{from: function, select: binary, where: [{any: [{left: {operator: '/'}}, {has: {block: index}}]}]}
{where: [{sequence: [{block: eth_transfer}, {block: state_write}]}]}
{where: [{sequence: [{block: state_write}, {block: state_write}, {block: state_write}]}]}
{from: function, where: [{sequence: [{block: lowlevel_call}, {block: require}]}, {visibility: external}]}
{where: [{sequence: [{block: call, arg.0: {tainted: parameter}}, {block: state_write}]}]}
{from: function, select: lowlevel_call, where: [{has_value: true}, {has_gas: true}, {arg.0: {block: literal}}]}
{from: function, select: call, where: [{arg.any: {tainted: sender}}]}
{from: function, select: guard, where: [{regex: 'keeper|ok'}]}
{from: function, select: state_write, where: [{modifier: 'only'}]}
{from: function, select: state_write, where: [{func_name: '^_'}]}
{from: function, select: state_write, where: [{guarded_by: {has: {name: '^sender$'}}}]}
{from: function, select: binary, where: [{unchecked_var: true}, {in: {block: unchecked}}]}
{from: main_contract, where: [{has: {block: variable, is_state_var: true, type: 'address'}}]}
{from: contract, where: [{has: {block: modifier}}]}
{from: any_contract, where: [{base: '^Root$'}, {has: {block: function, name: hook}}]}
{from: library, where: [{has: {block: parameter}}]}
{from: abstract, where: [{has: {block: emit}}]}
{from: function, select: member, where: [{name: '^tx\\.origin$|^block\\.'}]}
{from: function, select: ternary}
{from: function, select: state_read, where: [{not: {in: {block: assign}}}]}
{from: function, select: identifier, where: [{try_part: '.*'}]}
{from: function, select: identifier, where: [{cond_role: 'if|loop'}]}
{from: function, where: [{has: {block: loop, loop_type: for}}, {mutability: payable}]}
{from: function, select: asm_sstore}
{from: function, select: call, where: [{version: '<0.8'}]}
{from: function, select: call, where: [{version: '>=0.8'}, {has_param: n}]}
{from: function, where: [{and: [{regex: 'super'}, {visibility: public}]}]}
{from: function, where: [{any: [{has: {block: emit}}, {has: {block: try_catch}}, {sequence: [{block: emit}, {block: call}]}]}]}
{from: function, and: [{select: state_write}, {select: call, where: [{name: '^_'}]}]}
{from: function, or: [{select: state_write}, {select: assign, where: [{right: {block: literal}}]}]}
{or: [{from: source, where: [{regex: 'sload'}]}, {select: asm_sload}]}
{from: source, where: [{regex: '(?i)unchecked|catch'}]}
{from: function, select: external_call, where: [{receiver_name: '^(Maths|total)$'}]}
""".strip().splitlines()


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("project")
    for name, text in FILES.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text, encoding="utf-8")
    return folder


@pytest.fixture(scope="module")
def db(spark, root):
    return codedb.build(spark, str(root))


def test_what_is_read(db, root):
    files = {r.path.removeprefix(f"{root}/") for r in db.files.collect()}
    assert files == {"src/Vault.sol", "src/Base.sol", "vendor/lib/Maths.sol"}
    assert {(r.code, r.message) for r in db.diagnostics.collect()} == {("import-unresolved", "./missing.sol")}
    assert [r.name for r in extract.inheritance(db, "Vault").collect()] == ["Vault", "Other", "Base", "Root"]
    done = {r.function_id.split("#")[1]: r for r in extract.effects(db).collect()}
    assert done["Vault.pay(address,uint256)"].controlled is True and {w.var for w in done["Vault._book(address,uint256)"].writes} == {"shares", "total"}
    assert {r.source for r in extract.flows_into(db, "held").collect()} == {"a"}
    assert {r.name: r.weight for r in db.contracts.collect()}["Vault"] == 4


def test_a_list_of_files(spark, root):
    some = codedb.build(spark, [str(root / "src/Base.sol"), str(root / "vendor/lib/Maths.sol")])
    assert {r.name for r in some.contracts.collect()} == {"Hooked", "Root", "Base", "Other", "Söl", "Maths", "Kept"}
    with pytest.raises(FileNotFoundError):
        codedb.build(spark, str(root / "test/nothing"))


def test_libraries_super_and_constructors(db):
    calls = {(r.src.split("#")[1], r.dst and r.dst.split("#")[1], r.type) for r in db.calls.collect()}
    assert ("Vault.hook()", "Maths.plus(uint256,uint256)", "library") in calls
    assert ("Vault.take(address,uint256)", "Maths.twice(uint256)", "library") in calls
    assert ("Maths.plus(uint256,uint256)", "Kept.keep(uint256)", "library") in calls
    # In Vault's order super of Other leads to Base, in Other's own to Root.
    assert {("Vault.hook()", "Other.hook()", "super"), ("Other.hook()", "Root.hook()", "super"), ("Other.hook()", "Base.hook()", "super"), ("Base.hook()", "Root.hook()", "super")} <= calls
    assert ("Vault.constructor", "Base.constructor", "constructor") in calls
    flow = {(r.function_id.split(".")[-1], r.source, r.target) for r in db.flows.collect()}
    assert ("_book(address,uint256)", "n", "shares") in flow and ("constructor", "a", "held") in flow
    f = extract.the_function(db, "hook", "Vault")
    assert {r.function_id.split("#")[1] for r in extract.workflow(db, f).collect()} >= {"Vault.hook()", "Maths.plus(uint256,uint256)", "Kept.keep(uint256)", "Other.hook()"}


def test_findings_carry_the_way_from_the_entry(db):
    t = rules.parse("{id: w, query: {select: state_write, where: [{left: {name: '^keeper$'}}]}}")
    got = {r.function: [p.split(".")[-1] for p in r.path] for r in scan(db, [t]).collect()}
    assert got["deep"] == ["deep(uint256)", "_a(uint256)", "_b(uint256)", "_c(uint256)"]


def test_scan_finds_what_the_relational_engine_finds(db):
    templates = [rules.parse(f"{{id: t{i}, query: {body}}}".replace("\\\\", "\\")) for i, body in enumerate(TEMPLATES)]
    got = sorted(map(str, scan(db, templates).collect()))
    want = sorted(map(str, Engine(db).findings(templates).collect()))
    assert got == want
    found = {r.template_id for r in scan(db, templates).collect()}
    assert len(found) >= len(templates) - 4


def test_json_round_trip(db, spark, tmp_path):
    db.to_json(str(tmp_path / "db"))
    again = codedb.CodeDB.from_json(spark, str(tmp_path / "db"))
    t = [rules.parse("{id: w, query: {where: [{sequence: [{block: eth_transfer}, {block: state_write}]}]}}"), rules.parse("{id: v, query: {from: function, select: guard, where: [{regex: ok}]}}")]
    assert sorted(map(str, scan(again, t).collect())) == sorted(map(str, scan(db, t).collect()))
    assert extract.difference_of(db, again).isEmpty()


def test_calls_beyond_the_bound_share_trees(db, spark, tmp_path, monkeypatch):
    """Two calls a level: 2 ** 10 ways, of which the last one's write must be found."""
    from gritstone.solidity import program

    body = "".join(f"function _{i}(uint256 n) internal {{ _{i + 1}(n); _{i + 1}(total); }} " for i in range(10))
    (tmp_path / "Fan.sol").write_text(f"pragma solidity 0.8.20; contract Fan {{ uint256 total; address owner; function go(uint256 n) external {{ _0(n); last(n); }} {body} function _10(uint256 n) internal {{ total = n; }} function last(uint256 n) internal {{ selfdestruct(payable(owner)); n; }} }}")
    fan = codedb.build(spark, str(tmp_path))
    t = [rules.parse("{id: a, query: {select: selfdestruct}}"), rules.parse("{id: b, query: {where: [{sequence: [{block: state_write}, {block: selfdestruct}]}]}}"), rules.parse("{id: c, query: {where: [{sequence: [{block: selfdestruct}, {block: state_write}]}]}}")]
    assert {r.template_id for r in scan(fan, t).collect()} == {"a", "b"}
    most = fan.nodes.filter("scope_id like 'entry%'").agg({"inst": "max"}).first()[0]
    assert program.OWN_INSTANCES <= most < program.OWN_INSTANCES + 200


def test_several_projects_at_once(spark, root, tmp_path):
    """Units of two projects, one table: names resolve within their own."""
    other = tmp_path / "other"
    other.mkdir()
    (other / "Base.sol").write_text("contract Base { function f() public {} } contract Own is Base { }")
    (ua, la), (ub, lb) = project.load(spark, str(root)), project.load(spark, str(other))
    from pyspark.sql import functions as F

    both = codedb.from_units(ua.withColumn("project", F.lit("a")).unionByName(ub.withColumn("project", F.lit("b"))), la.withColumn("project", F.lit("a")).unionByName(lb.withColumn("project", F.lit("b"))))
    mine = both.lineage.join(both.contracts.filter("name = 'Own'").select("contract_id"), "contract_id").orderBy("pos").collect()
    assert [r.base_id.split("/")[-1] for r in mine] == ["Base.sol#Own", "Base.sol#Base"] and str(other) in mine[1].base_id
