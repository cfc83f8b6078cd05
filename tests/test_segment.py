"""Stages of episodes against the rules written out in plain numbers, frame by frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tempora.operators import segment as S
from tempora.operators import temporal

SCHEMA = "episode_index long, frame_index long, timestamp double, action array<double>, state array<double>, task string"


def rules(t,A,ST,fps,task,ver):
    n=len(t); A=A.copy(); margin={"DVT1":.6,"DVT2":.2}[ver]
    if n<50: return None,f"too few frames ({n}) for 5 stages",None
    if ver=="DVT2":
        for X in (A,ST):
            if X is None: continue
            for g in (7,15):
                if g<X.shape[1]:
                    f=X[:,g][np.isfinite(X[:,g])]
                    if f.size and np.abs(f).max()>1.5: X[:,g]=X[:,g]/100
    low=task.lower(); pick="pick" in low; place="place" in low or "put" in low; give="give" in low or "hand" in low
    sd=0 if ST is None else ST.shape[1]
    tr=[]
    flips=lambda x:[i for i in range(1,n) if (x[i]>.5)!=(x[i-1]>.5)]
    for g in (7,15):
        if g>=A.shape[1]: continue
        for f in flips(A[:,g]):
            s=f
            if g<sd:
                later=[x for x in flips(ST[:,g]) if x>=f]
                if later: s=later[0]
            tr.append((f,s,g))
    if not tr: return None,(f"no gripper transition found (task: '{task}')" if pick else "no gripper transition found"),None
    direct=False
    src=lambda g: ST[:,g] if g<sd else A[:,g]
    if give and len(tr)<2:
        x=src(tr[0][2]); x=x[np.isfinite(x)]
        if x.size>1 and x[0]>.5 and x[-1]<=.5: direct=True
        else: return None,f"give task needs >=2 gripper transitions or one closed-to-open direct-give transition, found {len(tr)}",None
    opens=0; seen=set()
    for f,s,g in sorted(tr,key=lambda r:r[0]):
        if g in seen: continue
        seen.add(g); x=src(g); fi=np.flatnonzero(np.isfinite(x))
        if not len(fi) or x[fi[0]]<=.5: continue
        c=min(max(s,f),n-1)
        if np.isfinite(x[c]) and x[c]<=.5: opens+=1
    exp=(2 if give else 1)+opens; many=[f for f,_,_ in tr] if len(tr)>exp else None
    if direct: r=tr[-1]; b2=b3=None
    elif give: g_=tr[-2]; r=tr[-1]
    else: g_=tr[-1]
    def win(fa,fs,least):
        lo=int(np.searchsorted(t,t[fa]-margin,"left")); hi=int(np.searchsorted(t,t[min(fs,n-1)]+margin,"right"))
        lo=max(least,lo); hi=min(n,hi)
        if hi-lo<10:
            m=(lo+hi)//2; lo=max(least,m-5); hi=lo+10
            if hi>n: hi=n; lo=max(least,hi-10)
        return lo,hi
    if not direct: b2,b3=win(g_[0],g_[1],0)
    if give: b5,b6=win(r[0],r[1],10 if direct else b3+10)
    arm=[k for k in range(A.shape[1]) if k not in (7,15,16,17,18)]
    if not arm: return None,"no arm action columns found",many
    w=max(round(fps),2); R=np.zeros(n)
    for k in arm:
        x=pd.Series(A[:,k]); R=np.maximum(R,(x.rolling(w,center=True,min_periods=1).max()-x.rolling(w,center=True,min_periods=1).min()).values)
    upper=b5 if direct else b2; d1=upper; pose=None
    if ver=="DVT2" and ST is not None:
        for i in range(max(0,min(upper,n))):
            for at,deg in S.POSES.items():
                if sd>=at+7 and np.isfinite(ST[i,at:at+7]).all():
                    d=np.abs(ST[i,at:at+7]-np.deg2rad(deg))
                    if np.sqrt((d**2).mean())<=np.deg2rad(1) and d.max()<=np.deg2rad(3) and pose is None: pose=i
    if pose is not None: d1=min(pose+max(1,round(fps*.2)),upper-1)
    else:
        for i in range(n):
            if R[i]>=.1 and (ST is None or (sd>1 and ST[i,1]>-.4) or (sd>9 and ST[i,9]>-.4)): d1=i; break
    if (pick or give) and ST is not None and upper>0:
        o=[]
        for g in (7,15):
            if g<sd:
                x=ST[:upper,g]; fi=[i for i in range(len(x)) if np.isfinite(x[i])]
                if fi and x[fi[0]]>.5:
                    c=[i for i in fi if x[i]<=.1]
                    if c: o.append(c[0])
        if o: d1=max(d1,max(o)+max(1,round(fps*.1)))
    d4=b3 if b3 is not None else b5; st=None
    if ver=="DVT2" and not give:
        k=max(1,round(fps*(.2 if place else .4)))
        for i in range(b3,n-k+1):
            f=R[i:i+k][np.isfinite(R[i:i+k])]
            if f.size and f.max()<=.08: st=i; break
    if st is not None: d4=st
    else:
        for i in range(n-1,-1,-1):
            if R[i]>=.06: d4=i+1; break
    hi=upper-(1 if pose is not None else 10)
    b1=max(10,min(hi,d1)) if hi>=10 else max(1,upper//2)
    m1=max(round(2*fps),10)
    if not direct and pose is None and b2-b1<m1: b1=max(10,b2-m1)
    at=lambda k: float(t[min(k,n-1)])
    if give: out=[at(b1),None if direct else at(b2),None if direct else at(b3-1),at(b5),at(b6-1)]
    else:
        lo=b3 if ver=="DVT2" else b3+10; top=n-10
        b4=max(lo,min(top,d4)) if lo<=top else (b3+n)//2
        out=[at(b1),at(b2),at(b3-1),at(b4),None]
    return (give,direct,out),None,many


def episode(rng, e: int, fps: float, aw: int, sw: int, ver: str):
    """A random episode: drifting arms, grippers that flip with a lag, start poses, gaps, scales of 0 to 100."""
    n = int(rng.choice([30, 55, 80, 200, 140]))
    t = np.arange(n) / fps + (0.001 * rng.random(n) if e % 5 == 0 else 0)
    A, ST = np.zeros((n, aw)), np.zeros((n, sw)) if sw else None
    for k in range(aw):
        if k % 3 == e % 3:
            a, b = sorted(rng.integers(0, n, 2))
            A[a:b, k] = np.cumsum(rng.normal(0, 0.05, b - a))
    scale = 100 if ver == "DVT2" and e % 2 else 1
    for g in (7, 15):
        if g < aw and (g == 7 or e % 3 == 0):
            x = np.full(n, float(rng.integers(0, 2)))
            for c in sorted(rng.integers(1, n, int(rng.integers(0, 4)))):
                x[c:] = 1 - x[c]
            A[:, g] = x * scale
            if sw > g:
                lag = int(rng.integers(0, 6))
                y = np.concatenate([np.full(lag, x[0]), x[: n - lag]])
                ST[:, g] = y * scale * (0.97 if e % 4 else 1) + (0.03 * scale if e % 7 == 0 else 0)
    if sw > 1:
        ST[:, 1] = rng.choice([-0.9, 0.0])
    if sw > 9:
        ST[:, 9] = -0.9
    if ver == "DVT2" and e % 3 == 1 and sw >= 7:
        ST[int(rng.integers(0, n)), 0:7] = np.deg2rad(S.POSES[0]) + 0.005
    if e % 6 == 0:
        A[rng.integers(0, n, 3), 0] = np.nan
    if e % 6 == 1 and sw:
        ST[rng.integers(0, n, 3), 7 if sw > 7 else 0] = np.nan
    if e % 11 == 0:
        A[:, 2] = np.nan
    return t, A, ST, ["Pick up the cube", "Give the cube to me", "Place it", "hand over", "wave", ""][e % 6]


def rows_of(e, t, A, ST, task):
    return [(e, i, float(t[i]), A[i].tolist(), None if ST is None else ST[i].tolist(), task) for i in range(len(t))]


@pytest.mark.parametrize(("ver", "aw", "sw", "fps"), [("DVT1", 16, 10, 10.0), ("DVT2", 19, 18, 10.0), ("DVT1", 8, 0, 7.0), ("DVT2", 16, 16, 30.0), ("DVT1", 17, 16, 5.0)])
def test_random_episodes(spark, ver, aw, sw, fps):
    rng = np.random.default_rng(aw + sw)
    rows, expected = [], {}
    for e in range(48):
        t, A, ST, task = episode(rng, e, fps, aw, sw, ver)
        rows += rows_of(e, t, A, ST, task)
        expected[e] = rules(t, A, None if ST is None else ST.copy(), fps, task, ver)
    bounds = S.boundaries(spark.createDataFrame(rows, SCHEMA).repartition(3), S.Signals(fps, aw, sw, ver))
    got = {}
    for r in bounds.collect():
        found = None if r.error else (r.is_give, r.direct_give, [r.stage0_end, r.stage2_start, r.stage2_end, r.stage4_start, r.stage4_end])
        got[r.episode_index] = (found, r.error, r.changes)
    assert got == expected
    assert len({(x or ([],))[0] for x, _, _ in expected.values() if x} | {e for _, e, _ in expected.values() if e}) > 2
    kinds = {(r.type, r.frames is None) for r in S.boundary_issues(bounds).collect()}
    assert kinds <= {("error", True), ("multi_gripper", False)} and ("error", True) in kinds


def grasped(n=200, grasp=100, motion=None, release=None):
    t, A, ST = np.arange(n) / 10, np.zeros((n, 16)), np.zeros((n, 10))
    A[grasp:release, 7] = ST[grasp:release, 7] = 1
    if motion is not None:
        A[motion:, 0] = 1.0
    return t, A, ST


def test_known_episodes(spark):
    """Without motion, with late motion, with a quick hand-over; too short; without a change."""
    cases = [(*grasped(), "Pick up"), (*grasped(motion=96), "Pick up"), (*grasped(release=104), "Give it"), (*grasped(n=30, grasp=20), "Pick up"), (*grasped(grasp=200), "Pick up"), (*grasped(grasp=0, release=100), "hand it")]
    rows = [r for e, c in enumerate(cases) for r in rows_of(e, *c)]
    bounds = S.boundaries(spark.createDataFrame(rows, SCHEMA), S.Signals(10.0, 16, 10)).cache()
    got = {r.episode_index: r for r in bounds.collect()}
    assert (got[0].stage0_end, got[0].stage2_start, got[0].stage2_end, got[0].stage4_end) == (7.4, 9.4, 10.6, None)
    assert (got[1].stage0_end, got[1].stage2_start) == (7.4, 9.4)
    assert got[2].is_give and round((got[2].stage4_start - got[2].stage2_end) * 10) == 11 and got[2].stage4_start <= got[2].stage4_end
    assert got[3].error == "too few frames (30) for 5 stages" and got[4].error == "no gripper transition found (task: 'Pick up')"
    assert got[5].direct_give and got[5].stage2_start is None
    # rows of transitions, as step functions, give the stages that are assigned, but for the closed ends of stages 2 and 4
    frames = spark.createDataFrame(rows, SCHEMA)
    stages = {(r.episode_index, r.frame_index): r.stage for r in S.assigned(frames, bounds).collect()}
    steps = {(r.episode_index, r.frame_index): r.state for r in temporal.step_function(frames, S.as_transitions(bounds)).collect()}
    apart = [k for k in stages if stages[k] != steps[k]]
    ends = {(e, round(x * 10)) for e, r in got.items() for x in (r.stage2_end, r.stage4_end) if x is not None}
    assert set(apart) <= ends and {stages[5, f] for f in range(200)} == {0, 3, 4, 5} and set(stages[3, f] for f in range(30)) == {0}
