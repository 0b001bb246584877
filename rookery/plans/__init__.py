"""Whole pages as one lazy plan each: feeds, threads, boards, inboxes and camp walls."""
