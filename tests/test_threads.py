from emberlens.operators import threads as TD
from emberlens.sources import lines, thread_dump


def lines_of(spark, text, file="d"):
    return spark.createDataFrame([(file, i + 1, x) for i, x in enumerate(text.split("\n"))], "file string, line_no long, line string")


PARKED = """"a" #1 tid=0x1 nid=0x1 waiting on condition
   java.lang.Thread.State: WAITING (parking)
\tat com.example.A.run(A.java:4)
\t- parking to wait for  <0xb> (a java.util.concurrent.locks.ReentrantLock$NonfairSync)

   Locked ownable synchronizers:
\t- <0xa> (a java.util.concurrent.locks.ReentrantLock$NonfairSync)

"b" #2 tid=0x2 nid=0x2 waiting on condition
   java.lang.Thread.State: WAITING (parking)
\tat com.example.B.run(B.java:8)
\t- parking to wait for  <0xa> (a java.util.concurrent.locks.ReentrantLock$NonfairSync)

   Locked ownable synchronizers:
\t- <0xb> (a java.util.concurrent.locks.ReentrantLock$NonfairSync)

"c" #3 tid=0x3 nid=0x3 in Object.wait()
   java.lang.Thread.State: WAITING (on object monitor)
\tat java.lang.Object.wait(Object.java:1)
\t- waiting on <0xc> (a java.lang.Object)
\t- locked <0xc> (a java.lang.Object)

"d" #4 tid=0x4 nid=0x4 waiting for monitor entry
   java.lang.Thread.State: BLOCKED (on object monitor)
\tat com.example.D.run(D.java:1)
\t- waiting to lock <0xc> (a java.lang.Object)"""


def test_parked_threads_that_hold_each_others_locks_are_a_deadlock(spark):
    t = thread_dump.threads(lines_of(spark, PARKED))
    chains = TD.blocked_by(t)
    # a monitor that its owner waits on is released
    assert sorted((r.waiter, r.holder, r.address) for r in chains.collect()) == [("a", "b", "0xb"), ("b", "a", "0xa")]
    assert [(r.cycle, r.members) for r in TD.deadlocks(chains).collect()] == [("a", "a,b")]
    assert {(r.waiter, r.length) for r in TD.chain_lengths(chains).collect()} == {("a", 2), ("b", 2)}


def test_chains_of_any_length_and_holders_that_come_last(spark):
    n = 26
    rows = [("d", f"t{i:03}", i, "WAITING", [f"0x{i}"], f"0x{i + 1}" if i < n - 1 else None, i) for i in range(n)]
    rows += [("d", "later", 900, "RUNNABLE", ["0x1"], None, 900), ("e", "later", 1, "RUNNABLE", [], "0x5", 0)]
    t = spark.createDataFrame(rows, "dump string, name string, tid int, state string, held array<string>, waits_for string, ord int")
    chains = TD.blocked_by(t)
    assert [r.holder for r in chains.where("waiter = 't000'").collect()] == ["later"]
    assert TD.chain_lengths(chains).where("waiter = 't001'").first().length == n - 1
    assert TD.deadlocks(chains).isEmpty()
    assert TD.chain_lengths(chains.limit(0)).isEmpty()


def test_idle_workers_and_threads_that_share_an_identity_are_not_stuck(spark):
    kind = "name string, tid string, state string, stack array<string>, cpu_ms double, elapsed_s double"
    work, idle = ["Example.work"], ["java.util.concurrent.ThreadPoolExecutor.getTask", "java.lang.Thread.run"]
    before = [("w", None, "WAITING", work, 1.0, 1.0), ("i", None, "WAITING", idle, 1.0, 1.0), ("x", None, "WAITING", work, None, None), ("x", None, "WAITING", work, None, None), ("r", "1", "RUNNABLE", work, 1.0, None), ("old", "2", "RUNNABLE", work, 9.0, 1.0), ("same", "3", "BLOCKED", work, 1.0, 5.0)]
    after = [(n, t, s, k, None if c is None else c + 1 if n == "r" else c - 1 if n == "old" else c, e if n == "same" or e is None else e + 1) for n, t, s, k, c, e in before]
    got = TD.compare(spark.createDataFrame(before, kind), spark.createDataFrame(after, kind)).collect()
    assert {(r.identity, r.classification, r.cpu_delta_ms, r.elapsed_delta_s) for r in got} == {("name:w", "persistent_wait", 0.0, 1.0), ("tid:1", "active_repeated_stack", 1.0, None)}


def test_one_dump_of_all_lines_is_cut_into_blocks(spark, monkeypatch):
    text = PARKED + '\n\nFound one Java-level deadlock:\n=====\n' + "\n".join(f'"w{i}":\n  waiting to lock monitor 0x{i} (object 0x2, a X),\n  which is held by "h{i}"' for i in range(6))
    d = lines_of(spark, text)
    seen = thread_dump.threads(d), thread_dump.reported_deadlocks(d)
    for x in seen:
        plan = x._jdf.queryExecution().executedPlan().toString()
        # windows over blocks of lines, and over one row for each block
        assert "windowspecdefinition(file" in plan and "line_no" in plan
        assert all("_b" in w.split("]")[0] for w in plan.split("windowspecdefinition(")[1:])
    whole = [sorted(map(str, x.collect())) for x in seen]
    monkeypatch.setattr(lines, "BLOCK", 3)
    cut = [sorted(map(str, x.collect())) for x in (thread_dump.threads(d), thread_dump.reported_deadlocks(d))]
    assert cut == whole and [len(x) for x in cut] == [4, 6]
    assert {(r.waiter, r.address, r.holder) for r in thread_dump.reported_deadlocks(d).collect()} == {(f"w{i}", f"0x{i}", f"h{i}") for i in range(6)}
