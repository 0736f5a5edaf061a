"""Plans that change tables: policies, commits, jobs, recovery, cycles."""
