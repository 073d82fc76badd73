"""Source detectors: a text with and one without each finding, and brute force for the searches that keep state."""

from __future__ import annotations

import random
import re

import pytest

from lodestream.detectors import engine
from lodestream.detectors.rules import RULES

CONTRACT = """// SPDX
pragma solidity ^0.8.0;

contract T {
    uint[] public numbers;

    function total() public view returns (uint) {
        uint t = 0;
        for (uint i = 0; i < numbers.length; i++) {
            t += numbers[i];
        }
        return t;
    }
}"""
VAULT = """impl Vault {
    pub fn withdraw(env: Env, user: Address, amount: i128) -> i128 {
        let balance: i128 = env.storage().instance().get(&key).unwrap();
        let remaining = balance - amount;
        if remaining < 0 {
            panic!("no");
        }
        unsafe {
            let raw = 0 as *const i128;
        }
        remaining
    }
}"""
ROLES = """impl A {
    pub fn grant_role(env: Env, caller: Address) {
        if true { caller.require_auth(); }
        env.storage().instance().set(&target, &role);
    }
    pub fn promote(env: Env, admin: Address) {
        assert_admin(&env, &admin);
        env.storage().instance().set(&target, &role);
    }
    pub fn pause(env: Env) {
        env.storage().instance().set(&k, &true);
    }
    pub fn mint(env: Env) {
        user.require_auth();
    }
}"""
EVENTS = """fn transfer() {
    env.events().publish((symbol_short!("transfer"), from.clone(), to.clone(), amount, amount), ());
    env.events().publish((symbol_short!("log"), Bytes::from_slice(&env, &[1, 2, 3])), ());
    env.events().publish((symbol_short!("ok"), from), ());
    env.events().publish((a, Pair<b, c>, d, e), (1, 2, 3, 4, 5));
}"""

#: (inventory id, file, text, lines of the findings)
CASES = [
    ("R08_uncached_length", "a.sol", CONTRACT, [9]), ("R08_uncached_length", "a.rs", CONTRACT, []), ("R09_post_increment", "a.sol", "for (;;i++ ;)\nfor (;;i++)\ni++;\nfor (;; i++ {", [1, 4]),
    ("R10_public_not_external", "a.sol", CONTRACT, [7]), ("R11_storage_reference", "a.sol", "string storage s = x;\nfunction f(string storage s)", [1]),
    ("R16_string_operations", "a.sol", 'string memory s;\nstring s = "a";\nx = string.concat(a, b);', [2, 3]),
    ("R19_timestamp", "a.sol", "/* now\n now */\nx = now;\n// now\nemit E(now);\nif (block.timestamp > y) {", [3, 6]), ("R20_tx_origin", "a.sol", "// tx.origin\nrequire(tx.origin == o);", [2]),
    ("R26_string_concatenation", "a.rs", "let s = String::new();\nx();\ns.push_str(a);\nlet t = String::new();\n1\n2\n3\n4\nt.push_str(b);", [1]),
    ("R27_clone", "a.rs", "a.clone();\nb.clone(); // ok\n", [1]), ("R28_vec_capacity", "a.rs", "Vec::new();\nVec::with_capacity(1);", [1]),
    ("R29_storage_access", "a.rs", "storage().instance().get(&a)\nstorage().persistent().get(&b)\nstorage().instance().get(&a)", [1]),
    ("R30_unbounded_loop", "a.rs", "while i < 10 {\nwhile go {\n// while\nfor x in env.storage().iter() {", [2, 4]),
    ("R31_return_docs", "a.sol", "function f() external returns (uint) {}\n/// @return x\nfunction g() public pure returns (uint) {}", [1]),
    ("R33_contract_interface", "a.sol", "abi.encodeCall(x);\nIERC(address(x));", [1, 2]), ("R34_abstract_visibility", "a.sol", "abstract contract A {\nuint public x;\nfunction f() public;\n}", [2]),
    ("R34_abstract_visibility", "a.sol", "contract A {\nuint public x;\n}", []), ("R35_payable_admin", "a.sol", "function f() external onlyOwner {\nfunction g() external payable onlyAdmin {", [1]),
    ("R39_string_compare", "a.sol", "x;\nkeccak256(abi.encodePacked(a)) == keccak256(b)", [2]), ("R40_self_call", "a.sol", "f();\nthis.g(1); this.h();", [2, 2]),
    ("R43_memory_copy", "a.sol", "bytes memory a; for (uint i;;) a[i] = b[i];", [1]), ("R44_view_state_access", "a.sol", "function f() view { sload(0); }", [1]),
    ("R45_memory_allocation", "a.sol", "\nnew uint[](9); x[];", [2]), ("R45_memory_allocation", "a.sol", "new uint[](9); x[];\nfor (;;)", []),
    ("R48_custom_errors", "a.sol", 'require(x > 1, "low");\n// require(x, "no")\nrevert("bad");', [1, 3]), ("R48_custom_errors", "a.sol", 'error Low(uint x);\nrequire(x > 1, "low");', []),
    ("R57_low_level_calls", "a.sol", 'x.call("");\ny.call{value: 1}("");\nz.delegatecall(d);', [1, 2, 3]), ("R60_downcasting", "a.sol", "a = uint256(b);\nc = uint8(d + 1);\ne = int16(f);", [1, 2, 3, 3]),
    ("R61_signature_recovery", "a.sol", "address a = ecrecover(h, v, r, s);", [1, 1, 1]), ("R63_erc20_approval", "a.sol", "t.approve(a, 1);", [1, 1]), ("R77_abi_encode", "a.sol", "abi.encode(a);\nabi.encodePacked(a);", [1]),
    ("R126_cached_length", "a.sol", "function f(uint[] memory m) {\nfor (;i < m.length;) {\nfor (;i < s.length;) {\nx = s.length;", [3]),
    ("R131_string_variable", "a.sol", "string public s;\nstring public t = f(\nuint public u;", [1]), ("R49_excessive_allocation", "a.rs", "[0; 1000]\nVec::with_capacity(999)\nVec::with_capacity( 5000 )", [1, 3]),
    ("R50_memory_copies", "a.rs", "a.clone();\nb.to_string();\nc.iter().map(x).collect()", [1, 2, 3]), ("R51_expensive_sload", "a.rs", "a.get(&x);\nlet b = c;\nd.get(&x);", [1]),
    ("R59_initializers", "a.rs", "fn initialize() {\nx.require_auth();", [1]), ("R59_initializers", "a.rs", "fn other()", [1]), ("R64_access_control", "a.rs", ROLES, [10]), ("R65_role_hierarchies", "a.rs", ROLES, [2]),
    ("R66_cross_contract", "a.rs", "Client::new(&env)", [1]), ("R66_cross_contract", "a.rs", "Client::new(&env)\nverify_contract(x)", []), ("R67_event_topics", "a.rs", EVENTS, [2, 3]),
    ("R68_symbol_usage", "a.rs", 'Symbol::new(&env, "a")\nSymbol::new(&env, "b")\nSymbol::new(&env, "a")', [1]), ("R69_inefficient_loop", "a.rs", "x\nfor (i)\n {\n env.storage(i); }", [2]),
    ("R70_unsafe_operations", "a.rs", VAULT, [3, 4, 6, 8, 9, 9]), ("R72_upgrade_guards", "a.rs", "fn upgrade(env: Env)", [1]), ("R91_randomness", "a.rs", "fn a() { x(); }\nfn b() {\n blockhash(1)\n}", [2]),
    ("R119_gas_lints", "a.rs", "for k in m.keys() {\nlet m: Map<u32, u32>;\n}\nenv.events().publish(x);\n", [1, 4]), ("R121_contract_lints", "a.rs", "pub fn f() {\n x.set(1);\n}", [1, 1]),
    ("R122_sdk_lints", "a.rs", "x\npub fn f(a: Address) {}", [1, 2]), ("R128_storage_rent", "a.rs", "let nonce = 1;\nenv.storage().persistent().set(&k, &v);\nenv.storage().instance().get(&k);", [2, 3]),
    ("R132_rust_plugin", "a.rs", 'String::from("a");\nb.clone();\nfor x in y {\n c.clone();\n if z {\n d.clone();\n }\n}\ne.clone();', [1, 4, 6]), ("R133_vyper_loop", "a.vy", "for x in xs:\nfor i in range(3):", [1]),
    ("R136_heuristics", "a.x", "for a in storage { s = 1; s = 2; }", [1, 1]), ("R136_heuristics", "a.x", f'string x; "{"y" * 64}"', [1]), ("R17_nested_loops", "a.sol", "for (a) {\n while (b) {\n }\n}\nif (c) {\n}", [2]),
    # A loop at top level is over only when another brace closes, so that the next one counts as nested.
    ("R17_nested_loops", "a.sol", "for (a) {\n}\nfor (c) {\n}", [3]),
]


def found(spark, detectors, texts):
    df = spark.createDataFrame([(f, t, "x", 1) for f, t in texts], "file string, source string, rule_id string, line int")
    return [(r.file, r.line, r.message) for r in engine.run(df, detectors).collect()]


@pytest.mark.parametrize("key", sorted(RULES))
def test_cases(spark, key):
    cases = [(f"{i}-{file}", text, lines) for i, (k, file, text, lines) in enumerate(CASES) if k == key]
    assert any(lines for _, _, lines in cases), "a rule needs a text that it finds something in"
    texts = [(f, t) for f, t, _ in cases] + [("empty.sol", ""), ("empty.rs", ""), ("null.sol", None), ("null.rs", None)]
    got = found(spark, RULES[key], texts)
    for file, _, lines in cases:
        assert sorted(line for f, line, _ in got if f == file) == lines, file
    assert not [x for x in got if x[0].startswith("null")]


def test_messages_name_what_was_found(spark):
    said = lambda key, file, text: [m for _, _, m in found(spark, RULES[key], [(file, text)])]
    assert said("R67_event_topics", "a.rs", EVENTS) == ["Excessive event topics: topic count exceeds 4.", "Excessive event topics: topics contain large payload types."]
    assert said("R40_self_call", "a.sol", "this.pay(1)") == ["Replace external `this.pay` invocation with an internal function call."]
    assert "'owner'" in said("R34_abstract_visibility", "a.sol", "abstract contract A {\naddress public owner;\n}")[0]
    assert "grant_role" in said("R65_role_hierarchies", "a.rs", ROLES)[0] and "pause" in said("R64_access_control", "a.rs", ROLES)[0]


def programs(n, seed):
    pick = random.Random(seed)
    pieces = ["for (a) {", "while (b) {", "if c {", "fn f() {", "fn g() {", "}", "}", "x.hit();", "y();", "for (z) x.hit();", ""]
    return [(f"{i}.rs", "\n".join(pick.choice(pieces) for _ in range(pick.randint(0, 25)))) for i in range(n)]


def in_loops(text):
    out, depth, base = [], 0, None
    for i, line in enumerate(text.split("\n"), 1):
        if re.search(r"^(for|while) ", line):
            base = depth
        depth += line.count("{") - line.count("}")
        if base is not None and depth <= base:
            base = None
        if base is not None and "hit" in line:
            out.append(i)
    return out


def bodies(text):
    out = []
    for m in re.finditer(r"fn (\w+)\(\)", text):
        depth, opened, end = 0, False, None
        for i in range(m.start(), len(text)):
            if text[i] == "{":
                depth, opened = depth + 1, True
            elif text[i] == "}":
                depth -= 1
                if opened and depth == 0:
                    end = i + 1
                    break
        if "hit" in text[m.start() : end or m.start() + 400]:
            out.append((text[: m.start()].count("\n") + 1, m.group(1)))
    return out


def test_searches_with_state_against_plain_loops(spark):
    texts = programs(150, 3)
    loops = engine.Detector("l", "x", engine.in_loops(r"^(for|while) ", "hit"), "m")
    functions = engine.Detector("b", "x", engine.bodies(r"fn (\w+)\(\)", "hit"), "{}")
    everywhere = engine.Detector("a", "x", engine.anywhere(r"hit|\{\s*if"), "{}")
    got = {d.rule_id: found(spark, [d], texts) for d in (loops, functions, everywhere)}
    assert sorted(x[:2] for x in got["l"]) == sorted((f, i) for f, t in texts for i in in_loops(t))
    assert sorted(got["b"]) == sorted((f, i, n) for f, t in texts for i, n in bodies(t))
    plain = [(f, t[: m.start()].count("\n") + 1, m.group()) for f, t in texts for m in re.finditer(r"hit|\{\s*if", t)]
    assert sorted(got["a"]) == sorted(plain) and len(plain) > 100


def test_long_text(spark):
    text = "fn f() {\n" * 3000 + "x.hit();\n" + "}\n" * 3000
    d = [engine.Detector("l", "x", engine.in_loops("^fn", "hit"), "m"), engine.Detector("a", "x", engine.anywhere("hit"), "m")]
    assert sorted(x[1] for x in found(spark, d, [("a.rs", text)])) == [3001, 3001]
