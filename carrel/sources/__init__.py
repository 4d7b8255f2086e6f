"""carrel.sources"""
