"""carrel.streaming"""
